"""Labelled pages from which the content model of ``html_extract`` is trained (fixed values).

``y="1"`` marks an element as main content and ``y="0"`` as anything else;
elements without the mark have their parent's label, and the page itself is
content where it begins with ``<!--y-->``.  The words are filler;
what the model learns from is markup, link share and text shape.
"""

PARAGRAPHS = (
    "Mora telin sabe, orun keles to vina. Rata den lomir esta, panu riole so miner takel.",
    "Lorin de salu, mave torin. Kela ruma to senda, ori lem vata. Sona tel mirun, pade loris en varo keta.",
    "Ama.",
    "Telo varin de somu lake. Orin pela, tasu mirel; vona ket lasur, emi. Dola run, save tikon mera lo pun.",
    "Siru kan tole vam.",
    "MORA!! TELIN!! SABE!! ORUN!! KELES!! VINA!! LOMIR!! PANU!!",
    "vara vara vara vara vara vara vara vara vara vara sumo sumo sumo sumo sumo sumo sumo sumo sumo",
    "Kela | ruma | senda | ori lem | vata | tel mirun | pade",
    "Tela### orim%%% sona*** vake&&& luri$$$ mota,### ena.%%%",
)
LINKS = '<a href="/a">Ruma</a> <a href="/b">Tole kan</a> <a href="/c">Vina</a>'
ITEMS = '<ul><li><a href="/a">Ruma</a></li><li><a href="/b">Tole</a></li><li><a href="/c">Vina sor</a></li></ul>'

LAYOUTS = (
    # whole bodies and fragments
    '<html y="0"><body y="1"><h1>@5</h1><p>@1</p><p>@2</p><p>@4</p></body></html>',
    '<html y="0"><head><title>@5</title></head><body y="1"><div class="menu" y="0">#I</div><h1>@5</h1>@1<br>@2<p>@4</p><div id="footer" y="0">@3 #L</div></body></html>',
    '<!--y--><p>@1</p><p>@2 <b>@5</b></p>',
    "<!--y-->@1 @2",
    "<!--y-->@5",
    '<article y="1"><p>@5</p><form y="0">@3</form><div class="ad" y="0">@1</div><p>@4</p></article>',
    '<div class="comments" y="0"><p>@1</p><p>@2</p></div><div id="content" y="1"><p>@2</p><p>@5</p></div>',
    '<nav y="0">#I</nav><main y="1"><p>@5</p></main><div class="footer" y="0">@2</div>',
    '<html y="0"><body><header><h1>@5</h1></header><main y="1"><h1>@5</h1><p>@3</p></main></body></html>',
    # article beside navigation, advert and footer
    '<html y="0"><head><title>@1</title></head><body><nav>#I</nav><div class="ad">@3</div>'
    '<article y="1"><h1>@5</h1><p><b>@1</b><br><p>@2</p><p>@3</p><p>@4</p></article><footer>&copy; host @5</footer></body></html>',
    '<html y="0"><body><nav>#I</nav><div class="ad">@2</div><article y="1"><h1>@3</h1><p>@5</p></article><footer>@4</footer></body></html>',
    # wrappers inside and outside the main text
    '<html y="0"><body><nav>#I</nav><article y="1"><div><div><div><p>@5</p></div></div><div><p>@1</p></div></div></article><footer>@2</footer></body></html>',
    '<html y="0"><body><div class="page"><div><div class="main" y="1"><div><div><h1>@5</h1></div><div><div><p>@1</p><p>@4</p></div></div></div></div></div>'
    '<div class="sidebar"><div><div><p>@2</p></div></div></div></div></body></html>',
    '<html y="0"><body><article y="1"><section><div><p>@5</p></div></section><section><div>@1</div></section></article>'
    '<footer><div><div>@1</div></div></footer></body></html>',
    # link lists and link paragraphs inside the main text
    '<html y="0"><body><nav>#I</nav><article y="1">#I</article><footer>#L</footer></body></html>',
    '<article y="1">#I</article>',
    '<article y="1"><p>@5</p><p><a href="/x">telo</a></p>#I</article>',
    '<html y="0"><body><nav>#L</nav><article y="1"><p>@5</p><p><a href="/x">telo</a></p>#I</article><aside>#I</aside><footer>@3</footer></body></html>',
    '<html y="0"><body><header>#L</header><main y="1"><h1>@5</h1>#I<p>#L</p><p>@1</p></main><div class="sidebar">#I</div></body></html>',
    '<html y="0"><body><div class="menu">#I</div><div class="content" y="1"><p>@1</p>#I<p>#L</p><p>@2</p>#I</div><div class="footer">#L</div></body></html>',
    '<html y="0"><body><article y="1"><h1>@5</h1><p>@1</p><h2>@3</h2>#I<p>@2</p><nav y="0">#I</nav><div class="related" y="0">#I</div></article></body></html>',
    # main element, header, sidebar
    '<html y="0"><body><header><h1>@5</h1><nav>#L</nav></header><main y="1"><h1>@5</h1><p>@1 <a href="/x">telo</a> @2</p><p>@4</p></main>'
    '<aside><h3>@5</h3><p>@2</p>#I</aside><footer><p>@3 #L</p></footer></body></html>',
    # class names only
    '<html y="0"><body><div id="header">@5 #L</div><div id="menu" class="menu">#I</div><div class="content" y="1"><h2>@5</h2><p>@1</p>'
    '<ul><li>@2</li><li>@4</li></ul><p>@3</p></div><div class="sidebar">@1 #I</div><div id="footer">@5</div></body></html>',
    '<html y="0"><body><div class="navbar">#L</div><div class="wrapper"><div class="post-body entry" y="1"><p>@1</p><blockquote>@2</blockquote>'
    '<p>@4</p></div><div class="related">@5 #I</div><div class="comments"><h3>@5</h3><div class="comment"><p>@2</p></div>'
    '<div class="comment"><p>@4</p></div></div></div></body></html>',
    # comments, forms, sharing and adverts inside the article
    '<html y="0"><body><article y="1"><header y="0">@5 #L</header><h1>@5</h1><p>@1</p><div class="advert" y="0">@4</div><p>@2</p>'
    '<table><tr><td>@5</td><td>@3</td></tr></table><div class="share social" y="0">#L</div><aside y="0">@1</aside><p>@4</p>'
    '<section id="comments" class="comments" y="0"><h2>@5</h2><ol><li><p>@1</p></li><li><p>@2</p></li></ol>'
    '<form><label>@5</label><button>@3</button></form></section><footer y="0">@5</footer></article></body></html>',
    '<html y="0"><body><div class="cookie-notice">@1 <button>@5</button></div><div role="navigation">#L</div><section class="article-text" y="1">'
    '<h1>@5</h1><h2>@3</h2><p>@2 <em>@5</em> @1</p><pre>@5</pre><p>@4</p></section><form class="newsletter"><p>@2</p></form>'
    '<div class="banner promo">@4</div></body></html>',
    '<html y="0"><body><div class="notice alert">@2</div><div class="breadcrumb">#L</div><div id="main"><div class="story" y="1"><p>@1</p>'
    '<p>@2 <a href="/q">@5</a> @4</p><dl><dt>@5</dt><dd>@1</dd></dl></div><div class="widget"><h4>@5</h4>#I</div></div>'
    '<div class="footer-links">#L @5</div></body></html>',
    # nothing but plain containers
    '<html y="0"><body><div>#L</div><div y="1"><p>@1 @2</p><p>@4 @1</p><p>@2</p></div><div>#I</div></body></html>',
    '<html y="0"><body><table><tr><td>#I</td><td y="1"><h1>@5</h1><p>@1 @4</p><p>@2</p></td></tr></table><p>#L</p></body></html>',
    '<html y="0"><body><div class="popup modal">@1<form>@5</form></div><article y="1"><div><h1>@5</h1><div><span>@1</span></div><div>@2<br>@4</div></div>'
    '<figure><figcaption>@5</figcaption></figure></article><div class="sponsored">@2 @1</div><section class="respond reply">@4</section></body></html>',
    '<html y="0"><body><header>@2</header><div class="page"><article y="1"><p>@4</p></article><aside class="sidebar"><p>@1</p><p>@2</p></aside></div>'
    '<div class="advertisement">@1 @2</div><footer>@1 @2</footer></body></html>',
)


def pages() -> list[str]:
    """The layouts filled with each rotation of the paragraphs."""
    out = []
    for shift in range(len(PARAGRAPHS)):
        for layout in LAYOUTS:
            page = layout.replace("#L", LINKS).replace("#I", ITEMS)
            for i in range(5):
                page = page.replace(f"@{i + 1}", PARAGRAPHS[(i + shift) % len(PARAGRAPHS)])
            out.append(page)
    return out
