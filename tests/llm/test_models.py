"""Toxicity, quality, HTML extraction and nearest neighbours: held-out accuracy, recall and edge cases."""

import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import ann, html_extract, html_pages, quality, toxicity
from churnlens.llm.common import table

SF = "/root/testdata/sf0.01"
MORE = [(-1, None), (-2, ""), (-3, "word " * 200_000), (None, "null id"), (-4, "same"), (-4, "same")]


def _auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("run, label, least", [(toxicity.toxicity, "toxic", 0.75), (quality.quality, "quality", 0.95)])
def test_held_out_accuracy_and_edge_rows(spark, docs_of, run, label, least):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(docs_of(MORE).select("doc_id", "text"))
    labels = table(spark, SF, "labels")
    odd = spark.createDataFrame([(-1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = run(docs, labels.unionByName(odd))
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    judged = out.join(labels, "doc_id").where("held_out").select("score", label).toPandas()
    assert _auc(judged["score"].to_numpy(), judged[label].to_numpy()) >= least
    same = {r["score"] for r in rows if r["doc_id"] in (-1, -2)}
    assert len(same) == 1


def test_models_without_labels(spark, docs_of):
    docs = docs_of(MORE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality.quality):
        assert {r["score"] for r in run(docs, none).collect()} == {0.0}
        assert run(docs.limit(0), none).count() == 0


def test_grammar_lowers_negated_and_reported_matches():
    lex = toxicity.Lexicon(toxicity._hash_list(["gronk"]), np.array([4.0]))
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)
    best = lambda t: toxicity.features(raw(t), np.array([0, len(t.encode())]), lex)[0, 0]
    plain = best("this gronk walks")
    assert best("you gronk walks") > plain and best("gronk, you") > plain
    assert best("he is not gronk") < plain and best("she said gronk") < plain
    assert best("not so. gronk here") == plain and best("nothing here") == 0


THREATS = [
    "I will kill you", "I'll burn your house down", "we are going to, we will beat all of you", "ich werde dich töten", "je vais te tuer",
    "te voy a matar", "go kill yourself", "you will be shot",
]
HARMLESS = [
    "kill the process and burn the CD", "how to burn calories and beat eggs; shoot photos, not videos", "I will beat eggs for you",
    "you can beat eggs", "I will help you kill the process", "don't hurt yourself", "I will shoot your wedding", "this will hurt a little",
]


def _scored(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return model.score(raw, np.array([0, len(raw)]))[0]


def test_threats_are_whole_patterns_not_verbs(spark):
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    nothing = _scored(model, "nothing here")
    assert nothing < 0.5
    assert all(_scored(model, t) == nothing for t in HARMLESS)
    assert all(_scored(model, t) > 0.5 for t in THREATS)
    assert _scored(model, "I will not kill you") < _scored(model, "I will kill you")
    assert _scored(model, "she said I will kill you") < _scored(model, "I will kill you")


def test_composed_machine_runs_every_transducer():
    rng = np.random.default_rng(6)
    for _ in range(400):
        word = rng.integers(0, len(toxicity.SYMBOLS), 12)
        state, own = 0, [0] * len(toxicity.PARTS)
        for x in word:
            insult, threat, order, passive, negation, reported, before = (p[1][s, x] for p, s in zip(toxicity.PARTS, own))
            assert toxicity.OUT[state, x] == insult * negation * reported * before
            assert toxicity.THREATS[state, x] == (threat + order + passive) * reported
            own = [p[0][s, x] for p, s in zip(toxicity.PARTS, own)]
            state = toxicity.NEXT[state, x]


def test_threat_transducer_equals_enumeration():
    letters = {"o": toxicity.OTHER, "H": toxicity.HARMS, "T": toxicity.TARGETS, "S": toxicity.SPEAKS, "W": toxicity.WILLS, "N": toxicity.NEGATES}
    found = 0
    for word in ("".join(w) for n in range(1, 7) for w in itertools.product(letters, repeat=n)):
        want = 0.0
        announced = re.search("S[^SW]{0,2}W", word)
        for i in range(announced.end() if announced else len(word), len(word)):
            if word[i - 1 : i + 1] == "HT" and i - 1 >= announced.end() or re.search("S[^SW]{0,2}WTH$", word[: i + 1]):
                want += toxicity.NEGATED if "N" in word[announced.start() : i] else 1.0
        state, got = 0, 0.0
        for x in word:
            got += toxicity.THREATS[state, letters[x]]
            state = toxicity.NEXT[state, letters[x]]
        assert got == want, word
        found += want > 0
    assert found > 300


def test_article_text_is_exact(spark):
    pages = table(spark, SF, "pages").collect()
    model = html_extract.train(html_pages.pages())
    texts = html_extract.main_texts(model, [p["html"] for p in pages])
    for p, got in zip(pages, texts):
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?!/?b\b)[^>]*>", " ", body).replace("<b>", "")).split())
        assert got == want


def _links(n):
    return "<ul>" + "".join(f"<li><a href=/x{i}>L{i}</a></li>" for i in range(n)) + "</ul>"


def test_pages_of_other_shapes(spark):
    cases = {
        "<article><p>A<!-- c --> b</p><form>f</form><div class='ad'>buy</div><p>C &lt;x&gt;&eacute;</p></article>": "A b C <x>é",
        "<p>Hel<b>lo</b> <i>you</i><br>there<p>x": "Hello you there x",
        "<body><nav>n</nav><main><h1>T</h1><script>if (a<b) '</p>'</script><ul><li>a<li>b</ul></main><footer>f</footer>": "T a b",
        "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>": "deep",
        "<article><p title=it's>Hello world</p><p>It's fine here, right.</p></article>": "Hello world It's fine here, right.",
        "<article><p class=\"a b\" d='q>r' id = \"z>\">one</p><p title=\"open>two</p><p x=/y/ z>three</p></article>": "one two three",
        f"<nav>{_links(4)}</nav><article>{_links(6)}</article>": "L0 L1 L2 L3 L4 L5",
        f"<article><p>A short one.</p><p><a href=/z>see this</a></p>{_links(3)}</article>": "A short one. see this L0 L1 L2",
        f"<body><nav>{_links(5)}</nav><article><p>Long, with commas, and more. Yes.</p>{_links(2)}<p>End of it all.</p></article>"
        f"<aside>{_links(4)}</aside></body>": "Long, with commas, and more. Yes. L0 L1 End of it all.",
        "<article><p>whole</p></article><p>cut <a hre": "whole",
    }
    rows = [(i, "u", h, 1) for i, h in enumerate(cases)] + [(90, None, None, 1), (91, "u", "", 1), (92, "u", "<", 1), (0, "u", next(iter(cases)), 1)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[90] == got[91] == "" and all(r["n_chars"] == len(r["text"]) for r in out)


def test_no_pages_and_very_long_pages(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []
    long = "<article>" + "<p>word &amp; word</p>" * 250_000 + "</article>"
    broken = "<article>" + "<a title='it \"x " * 300_000 + "<b title=it's \"y" * 300_000
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([(1, "u", long), (2, "u", broken)], schema)).collect()}
    assert got[1]["text"] == " ".join(["word & word"] * 250_000) and got[2]["n_chars"] == len(got[2]["text"])


def test_a_tag_is_cut_like_a_state_machine_does():
    def tag_end(page):
        """Index after the tag that begins at 0: quotes count only right after an equals sign and if they close."""
        at, n = 1, len(page)
        while at < n and page[at] != ">":
            if page[at] != "=":
                at += 1
                continue
            at += 1
            while at < n and page[at].isspace():
                at += 1
            if at < n and page[at] in "\"'" and page.find(page[at], at + 1) >= 0:
                at = page.find(page[at], at + 1) + 1
            elif at < n and page[at] not in ">\"'":
                while at < n and page[at] != ">" and not page[at].isspace():
                    at += 1
        return min(at + 1, n)

    rng = np.random.default_rng(4)
    for _ in range(3000):
        page = "<a " + "".join(rng.choice(list("x= \"'>/<"), 14))
        assert html_extract.TOKEN.match(page).end() == tag_end(page), page


def test_messages_equal_enumeration():
    rng = np.random.default_rng(1)
    n = 7
    parent = np.array([-1, 0, 0, 1, 1, 2, 4])
    depth = np.array([0, 1, 1, 2, 2, 2, 3])
    levels = [np.flatnonzero(depth == d) for d in range(4)]
    x, kind = rng.normal(size=(n, html_extract.N_FEATURES)), rng.integers(0, 3, n)
    model = html_extract.Model(rng.normal(size=html_extract.N_FEATURES + 1) * 0.3, rng.normal(size=(3, 2, 2)))
    z = np.column_stack((x, np.ones(n))) @ model.weights
    total, ones = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = np.array([(bits >> i) & 1 for i in range(n)])
        e = np.exp((z * y).sum() + sum(model.pair[kind[i], y[i], y[parent[i]]] for i in range(1, n)))
        total, ones = total + e, ones + e * y
    assert np.allclose(model.marginals(parent, levels, x, kind), ones / total)


def test_nearest_neighbours_recall_and_order(spark):
    rows = table(spark, SF, "embeddings")
    out = ann.nearest(rows, rows.where("vec_id % 20 = 0")).toPandas()
    data = rows.toPandas().sort_values("vec_id")
    x, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    hit = 0
    for q, g in out.groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[np.searchsorted(ids, g["vec_id"])], atol=1e-12)
        assert sorted(zip(-g["score"], g["vec_id"])) == list(zip(-g["score"], g["vec_id"]))
        hit += len(set(np.lexsort((ids, -s))[:20]) & set(np.searchsorted(ids, g["vec_id"])))
    assert hit / len(out) >= 0.9 and out["query_id"].nunique() == (ids % 20 == 0).sum()


@pytest.mark.parametrize("lengths", ["one slightly longer", "one long", "spread", "two"])
def test_nearest_neighbours_of_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    scale = {"spread": rng.lognormal(0, 0.5, len(x)), "two": rng.choice([1.0, 1.3], len(x))}.get(lengths, np.ones(len(x)))
    if lengths.startswith("one"):
        scale[7] = 10.0 if lengths == "one long" else 1.001
    x *= scale[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 120 and hit / (20 * len(got)) >= 0.9


def _pairs(x, queries, k=20):
    """(query, neighbour) vectors by brute force."""
    q, near = [], []
    for i in queries:
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[:k]
        q += [x[i]] * k
        near += list(x[top])
    return np.array(q), np.array(near)


@pytest.mark.parametrize("dim, spread", [(32, 0.0), (256, 0.0), (256, 0.1)])
def test_fitted_probes_reach_recall_in_any_dimension(dim, spread):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(6000, dim))
    x *= (rng.lognormal(0, spread, len(x)) / np.linalg.norm(x, axis=1))[:, None]
    setting = ann.fit_settings(*_pairs(x, range(64)), len(x), len(x) // 20)
    q, near = (ann._unit(v) for v in _pairs(x, range(1000, 1100)))
    found = np.zeros(len(q), bool)
    for t in range(setting.tables):
        mine = ann.buckets(near, t, setting.order, 1)
        found |= (ann.buckets(q, t, setting.order, setting.probes) == mine).any(axis=1)
    assert found.mean() >= 0.9


def test_candidate_share_falls_with_rows_on_clustered_data():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(200, 64)), 30, axis=0) + 0.4 * rng.normal(size=(6000, 64))
    q, near = _pairs(x, range(0, 6000, 100))
    share = []
    for rows in (2_000, 200_000, 20_000_000, 2_000_000_000):
        s = ann.fit_settings(q, near, rows, rows // 20)
        share.append(s.tables * s.probes / 128**s.order)
    assert share == sorted(share, reverse=True) and share[-1] < share[0] / 4 and share[0] < 0.25


@pytest.mark.parametrize("order", [1, 2])
def test_probes_are_the_nearest_buckets(order):
    rng = np.random.default_rng(3)
    q, x = (ann._unit(rng.normal(size=(200, 6))) for _ in range(2))
    for table in (0, 1):
        a, b = ann.signed_axes(q, table), ann.signed_axes(q, table, 1)
        every = a if order == 1 else (a[:, :, None] + b[:, None, :]).reshape(len(q), -1)
        got = ann.buckets(q, table, order, 20)
        assert np.allclose(np.take_along_axis(every, got, 1), -np.sort(-every, axis=1)[:, :20])
        ranks = ann.probe_ranks(q, x, table, order)
        whole = ann.buckets(q, table, order, 16**order)
        # the probe at that rank is the bucket of x, or ties with it
        at_rank, own = (np.take_along_axis(every, at, 1) for at in (np.take_along_axis(whole, ranks[:, None], 1), ann.buckets(x, table, order, 1)))
        assert np.allclose(at_rank, own)


def test_order_two_and_unseen_dimensions_are_searched(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + 0.1 * rng.normal(size=(1200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), settings={16: ann.Setting(2, 4, 40)}).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = [len(set(found) & set(np.argsort(-np.where(np.arange(1200) == q, -np.inf, x @ x[q]))[:20].tolist())) for q, found in got.items() if q < 1200]
    assert len(hit) == 60 and np.mean(hit) >= 18
    assert all(len(set(v)) == 20 and all((i >= 5000) == (q >= 5000) for i in v) for q, v in got.items()) and {5000, 5020} < set(got)


def test_nearest_neighbours_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (100, [inf, 0.0]), (120, []), (None, [1.0, 0.0])]
    vectors += [(i, [0.5, 0.5]) for i in range(1, 60) if i % 20] + [(200, [3.0, 0.1]), (201, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    out = ann.nearest(df, df.where(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect()
    first = [r["vec_id"] for r in out if r["query_id"] == 0]
    assert first == [200] + [i for i in range(1, 60) if i % 20][:19]
    assert {r["query_id"] for r in out} == {0, 200} and [r["rank"] for r in out if r["query_id"] == 200] == list(range(1, 21))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    two = df.where("vec_id in (0, 200)")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in ann.nearest(two, two).orderBy("query_id").collect()] == [(0, 200, 1), (200, 0, 1)]
