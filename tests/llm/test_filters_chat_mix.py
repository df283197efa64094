"""URL filters, chat formatting and mixing: edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from churnlens.llm import chat, mixing, url_filter

PAGES = "page_id long, url string, html string, rule string, path int"


def test_urls_and_precedence(spark):
    urls = [
        "https://A.com/x", "http://example.com/en/1", "http://www.example.com/en/1", "http://b.www.example.com/en/", "http://example.com",
        "http://x.net/es/", "http://x.net/ES/", "http://net/fr/?q", None, "", "no scheme.com/", "x://", "http://com./", "http://evilcom/a",
        "http://example.com:80/en/", "http://www.example.com/en?x=/en/", "h://" + "a." * 3000 + "com/" + "p/" * 3000, "http://a.com\n/b",
    ]
    df = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)] * 2, PAGES)
    rows = url_filter.judge(df, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(rows) == 2 * len(urls)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows}
    want = ["com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", None, "net/es/", None, "net/fr/", None, None, None, None,
            None, None, None, "com/", "com/", None]
    assert [got[i][0] for i in range(len(urls))] == want
    verdicts = dict(url_filter.RULES)
    assert all(v == verdicts.get(r, "allow") for r, v in got.values())


def test_rules_of_any_shape(spark):
    rules = [("a.b/x", "block"), ("b/", "allow"), ("a.b", "allow"), ("b/xyz", "block"), ("b/xyz", "allow"), ("", "block")]
    df = spark.createDataFrame([(1, "h://c.a.b/x1", "", "", 0), (2, "h://b/xyz1", "", "", 0), (3, "h://a.b", "", "", 0)], PAGES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, rules)).collect()}
    # equal length: the longer host, and block over allow for one rule text
    assert got == {1: ("a.b/x", "block"), 2: ("b/xyz", "block"), 3: ("a.b", "allow")}
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    none = url_filter.rule_table(spark, rules).limit(0)
    assert {r["verdict"] for r in url_filter.judge(df, none).collect()} == {"allow"}


CHAT = "conv_id long, turn long, role string, text string, turns int"


def test_chat_round_trip_of_conflicting_content(spark):
    texts = ["plain", "<|im_end|>", "<\\|x", "<\\\\|im_start|>", "<|im_start|>assistant\nhi", "a<", "", None, "<|other|>", "ends <|im_end|", "é\n<|im_end|>\n" * 50]
    rows = [(c, t, role, x, 0) for c, role in enumerate(["user", "assistant", "odd\nrole<%", None]) for t, x in enumerate(texts)]
    rows += [(9, 0, "assistant", "twice", 0)] * 2 + [(None, 1, "assistant", "b", 0), (None, None, "user", "a", 0)]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    for c in out:
        mine = [(t if t is not None else -1, role or "", x or "") for cc, t, role, x, _ in rows if cc == c]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in sorted(mine)]
    digests = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, CHAT))).collect()}
    loss = "".join(x or "" for x in texts)
    assert digests[1]["loss_chars"] == len(loss) and digests[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert digests[0]["loss_chars"] == 0 and digests[9]["n_turns"] == 2
    assert not out[9]["escaped"] and out[9]["formatted"].startswith("<|im_start|>assistant\ntwice<|im_end|>\n")
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_of_a_very_long_text(spark):
    text = "ab <|im_end|>\n" * 100_000
    rows = [(1, 0, "user", "q", 0), (1, 1, "assistant", text, 0)]
    formatted = chat.format_chats(spark.createDataFrame(rows, CHAT))
    assert formatted.collect()[0]["turns"][1]["text"] == text
    digest = chat.digests(formatted).collect()[0]
    assert digest["loss_chars"] == len(text) and digest["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def _brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in capped}
        rest = total - sum(capped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in share if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **share}
        capped.update({s: 2.0 * sizes[s] for s in over})


@pytest.mark.parametrize("shape", [{"a": 5, "b": 60, "c": 7, None: 3, "é": 40}, {"x": 10}, {"a": 1, "b": 1, "c": 300}])
def test_mix_meets_targets(spark, docs_of, shape):
    rows, i = [], 0
    for s, n in shape.items():
        for k in range(n):
            rows.append((i, "w " * (1 + k % 7), s))
            i += 1
    rows += [(None, None, "a"), (3, "", "a"), (3, "", "a")]
    df = docs_of(rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = _brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.5 + 1e-9
    again = mixing.mix(df.repartition(7).orderBy(F.rand(1))).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_of_nothing(docs_of):
    df = docs_of([(1, "a b", "s")])
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs_of([(1, None, "s"), (2, " ", None)])).collect()] == [0, 0]


def test_mix_of_a_very_long_text_and_many_rows_without_id(docs_of):
    rows = [(1, "w " * 600_000, "s"), (2, "w " * 10, "s")] + [(None, "w " * (k % 5), "t") for k in range(2000)]
    out = mixing.mix(docs_of(rows)).collect()
    sizes = {s: sum(r["size"] for r in out if r["source"] == s) for s in "st"}
    assert sizes == {"s": 600_010, "t": 4000} and {r["size"] for r in out if r["doc_id"] == 1} == {600_000}
    want = _brute_targets(sizes)
    for s in sizes:
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - want[s]) <= 0.5 + 1e-9
    assert all(r["taken"] <= 2 * r["size"] for r in out)
