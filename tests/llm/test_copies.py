"""Near copies, repeated passages and benchmark passages against brute force."""

import random

import numpy as np

from churnlens.llm import decontaminate, neardup, substring
from churnlens.llm.text import split_words


def _grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("klmno") * 3
    return words


def _brute_classes(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(frozenset(_grams(split_words(t))))
    parent = {d: d for d in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_near_copies_equal_brute_force(docs_of):
    rng = random.Random(5)
    rows, i = [], 0
    line = _words(rng, 13)
    for _ in range(12):  # groups of near copies, around the threshold as well
        base = _words(rng, rng.choice([8, 30, 60, 200]))
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, " ".join(_edited(rng, base, rng.randrange(0, 1 + len(base) // 25)))))
            i += 1
    for _ in range(80):  # short texts around one common line: similar, but not enough
        rows.append((i, " ".join(line + _words(rng, rng.randrange(2, 9)))))
        i += 1
    base = _words(rng, 50)
    for _ in range(60):  # one large group whose members differ in two places
        rows.append((i, " ".join(_edited(rng, base, 2))))
        i += 1
    rows += [(900, "exact copy of some words here"), (901, "Exact  COPY of some\nwords here"), (902, "a b"), (903, "A\tB"), (904, "b a")]
    rows += [(905, ""), (906, None), (907, " \n"), (None, "a b"), (905, ""), (908, "w " * 40_000), (909, "w " * 39_000)]
    rows += [(910, "one text of this document only"), (910, "a b")]  # rows of one id are one document
    out = neardup.near_duplicates(docs_of(rows)).collect()
    assert len(out) == len(rows)
    want = _brute_classes(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {(r["doc_id"], r["n_shingles"]) for r in out}
    assert {(d, len(set(_grams(split_words(t))))) for d, t in rows} == sizes


def test_near_copies_of_nothing(docs_of):
    assert neardup.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    out = neardup.near_duplicates(docs_of([(1, None), (2, "")])).collect()
    assert [(r["n_shingles"], r["kept"]) for r in out] == [(0, True)] * 2


def test_fenwick_chains_equal_quadratic_search():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        x0, y0 = rng.integers(0, 60, n), rng.integers(0, 60, n)
        ln, w = rng.integers(0, 6, n), rng.integers(1, 5, n)
        x1, y1 = x0 + ln, y0 + ln
        best = {}
        for i in sorted(range(n), key=lambda i: x0[i]):
            gains = [best[j] - substring.GAP_COST * (x0[i] - x1[j] + y0[i] - y1[j]) for j in best if x1[j] < x0[i] and y1[j] < y0[i]]
            best[i] = w[i] + max([0.0, *gains])
        chain = substring.chains(x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist(), w.tolist())[0]
        worth = sum(w[i] for i in chain) - sum(
            substring.GAP_COST * (x0[b] - x1[a] + y0[b] - y1[a]) for a, b in zip(chain, chain[1:])
        )
        assert abs(worth - max(best.values())) < 1e-9


def test_repeated_passages_are_found_and_cut(docs_of):
    rng = random.Random(8)
    exact, fuzzy, short = _words(rng, 70), _words(rng, 80), _words(rng, 45)
    rows = []
    for d in range(40):
        parts = [_words(rng, 60)]
        if d % 3 == 0:
            parts.append(exact)
        if d % 5 == 0:
            parts.append(_edited(rng, fuzzy, 1))
        if d % 7 == 0:
            parts.append(short)
        parts.append(_words(rng, 40))
        rows.append((d, " \n".join(" ".join(p) for p in parts)))
    rows += [(100, None), (101, ""), (None, " ".join(exact)), (102, " ".join(exact)), (103, "tiny"), (102, " ".join(exact))]
    df = docs_of(rows)
    spans = substring.repeated_spans(df)
    found = {}
    for r in spans.collect():
        found.setdefault(r["doc_id"], []).append(r)
    carriers = {d for d in range(40) if d % 3 == 0 or d % 5 == 0} | {102}
    assert set(found) == carriers - {0}  # document 0 is the first to have both
    assert all(r["first_doc_id"] < d for d, rs in found.items() for r in rs)
    left = {r["doc_id"]: r["text"] for r in substring.remove_spans(df, spans).collect()}
    assert 102 not in left and left[100] is None and left[101] == "" and left[0] == rows[0][1]
    joined = {d: " ".join(split_words(t)) for d, t in left.items() if d is not None}
    assert sum(" ".join(exact) in t for t in joined.values()) == 1
    assert joined[7].count(" ".join(short)) == 1  # too short to be a passage
    for d in range(40):
        if d not in carriers:
            assert left[d] == rows[d][1]
    assert substring.repeated_spans(df.limit(0)).count() == 0


def _covered(spans):
    out = {}
    for r in spans:
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_passages_of_frequent_lines_equal_brute_force(docs_of):
    rng = random.Random(21)
    docs = []
    for pool, first in ((40, 0), (400, 1000)):
        lines = [_words(rng, 13) for _ in range(pool)]
        some = [[rng.choice(lines) for _ in range(12)] for _ in range(300)]
        for a in range(0, 40, 2):  # pairs that share six lines in order
            some[a + 201][3:9] = some[a][5:11]
        docs += [(first + d, [w for line in x for w in line]) for d, x in enumerate(some)]
    spans = substring.repeated_spans(docs_of([(d, " ".join(w)) for d, w in docs])).collect()
    covered, seen = _covered(spans), set()
    for d, words in docs:
        windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        for i, x in enumerate(windows):
            if x in seen:
                assert set(range(i, i + 50)) <= covered.get(d, set()), (d, i)
        seen.update(windows)
    assert all((first + a + 201) in covered for first in (0, 1000) for a in range(0, 40, 2))


def test_fuzzy_groups_equal_brute_force(docs_of):
    rng = random.Random(22)
    rows, groups = [], []
    for g in range(12):
        base, group = _words(rng, rng.randrange(55, 71)), []
        for c in range(25):
            copy = _edited(rng, base, 0 if c == 20 else 1)
            before = rng.randrange(10, 40)
            group.append((1000 * c + g, before, copy))
            rows.append((1000 * c + g, " ".join(_words(rng, before) + copy + _words(rng, 30))))
        groups.append(group)
    covered = _covered(substring.repeated_spans(docs_of(rows)).collect())

    def similar(a, b):
        for i in range(len(a) - 49):
            for j in range(i + 50, len(a) + 1):
                x, y = set(_grams(a[i:j])), set(_grams(b[i:j]))
                if a[i] == b[i] and a[j - 1] == b[j - 1] and 100 * len(x & y) >= 75 * len(x | y):
                    return True
        return False

    for group in groups:
        for c, (d, before, words) in enumerate(group):
            if any(similar(words, other) for _, _, other in group[:c]):
                assert len(covered.get(d, set()) & set(range(before, before + len(words)))) >= 50, d


def test_passages_with_words_put_in(docs_of):
    rng = random.Random(23)
    rows, want = [], {}
    for g, (n, at, more) in enumerate([(90, 45, 13), (100, 30, 13), (200, 100, 40), (60, 30, 5), (120, 60, 25)]):
        base = _words(rng, n)
        rows.append((g, " ".join(_words(rng, 30) + base + _words(rng, 30))))
        rows.append((100 + g, " ".join(_words(rng, 25) + base[:at] + _words(rng, more) + base[at:] + _words(rng, 30))))
        want[100 + g] = set(range(25, 25 + n + more))
        rows.append((200 + g, " ".join(_words(rng, 25) + base + _words(rng, 30) + base[:5] + _words(rng, 20))))
        want[200 + g] = set(range(25, 25 + n))
    assert _covered(substring.repeated_spans(docs_of(rows)).collect()) == want


def test_benchmark_items_equal_brute_force(spark, docs_of):
    rng = random.Random(4)
    items = [(i, " ".join(_words(rng, rng.choice([3, 15, 20, 40])))) for i in range(12)] + [(50, None), (51, ""), (3, "x y z")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = []
    for d in range(60):
        i, t = items[d % 12]
        words = t.split()
        if d % 4 == 1:
            words = _edited(rng, words, 1)
        around = _words(rng, 20) if len(words) >= 5 and d % 4 != 3 else []
        rows.append((d, " ".join(around + (words if d % 4 != 2 else words[: len(words) // 2]) + around)))
    rows += [(200, None), (201, ""), (202, items[1][1].upper() + "!!"), (203, " ".join(_words(rng, 500)))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    import math
    import re

    norm = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    grams = {(i, t): _grams(norm(t)) for i, t in items if norm(t)}
    n_items = sum(t is not None for _, t in set(items))
    df: dict = {}
    for g in grams.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1
    weight = lambda x: 1 + math.log(n_items / df.get(x, 1))
    want = set()
    for d, t in rows:
        words = norm(t)
        have = _grams(words)
        for (i, _), g in grams.items():
            if len(g[0]) < 5 or len(words) < 5:
                if have == g:
                    want.add((d, i))
                continue
            for a in range(max(1, len(have) - len(g) + 1)):
                part = have[a : a + len(g)]
                low = sum(weight(x) * min(part.count(x), g.count(x)) for x in set(g))
                high = sum(weight(x) * max(part.count(x), g.count(x)) for x in set(g) | set(part))
                if 100 * low >= 75 * high - 1e-9:
                    want.add((d, i))
                    break
    assert got == want and (202, 1) in got
    kept = decontaminate.remove_contaminated(docs_of(rows), bench)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(docs_of(rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(rows).limit(0), bench).count() == 0


def test_benchmark_blocks_do_not_change_results(spark, docs_of, monkeypatch):
    import math

    rng = random.Random(6)
    stock, items = _words(rng, 47), []
    for i in range(9):  # an instruction that all items have, and words of their own
        items.append((i, stock + _words(rng, 7)))
    items += [(20 + i, _words(rng, 20)) for i in range(4)]
    rows = [(0, stock), (1, stock + _words(rng, 7)), (2, _words(rng, 9) + items[8][1]), (3, _edited(rng, items[10][1], 1)), (4, stock[:30] + items[11][1])]
    rows += [(5, items[2][1][:-2] + _words(rng, 2))]
    count: dict = {}
    for _, w in items:
        for g in set(_grams(w)):
            count[g] = count.get(g, 0) + 1
    weight = lambda g: 1 + math.log(len(items) / count.get(g, 1))
    want = set()
    for d, words in rows:
        have = _grams(words)
        for i, w in items:
            g = set(_grams(w))
            for a in range(max(1, len(have) - len(g) + 1)):
                part = set(have[a : a + len(g)])
                if 100 * sum(map(weight, part & g)) >= 75 * sum(map(weight, part | g)):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = docs_of([(d, " ".join(w)) for d, w in rows])
    assert (2, 8) in want and not any(d == 0 for d, _ in want)
    for block in (4096, 3, 1):
        monkeypatch.setattr(decontaminate, "ITEMS", block)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want, block


def test_several_texts_under_one_id_lose_no_passage_and_no_text(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(17)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, also = own(70), own(60)
    texts = [own(40), f"{own(30)} {passage} {own(20)}", f"{own(10)} {also}"]
    rows = [(1, f"{own(25)} {passage}"), (2, texts[0]), (2, texts[1]), (2, texts[1]), (0, f"{also} {own(30)}"), (2, texts[2])]
    docs = docs_of(rows)
    spans = substring.repeated_spans(docs).collect()
    assert {(r["doc_id"], r["n_words"], r["first_doc_id"]) for r in spans} == {(2, 70, 1), (2, 60, 0)}
    left = [r["text"] for r in corpus_pipeline.cut_passages(spark, docs, "").collect()]
    assert sum(passage in t for t in left) == 1 and sum(also in t for t in left) == 1
    assert sum(t == texts[0] for t in left) == 1 and len(left) == len(rows)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(rows))


def test_contamination_of_very_long_and_repeated_rows(spark, docs_of):
    words = [f"w{i}" for i in range(60)]
    item, filler = " ".join(words[:30]), " ".join(f"z{i % 997}" for i in range(200_000))
    bench = spark.createDataFrame([(7, item, "x")], "item_id long, text string, doc_id string")
    rows = [(1, f"{filler} {item} {filler}"), (2, item), (2, item), (2, "other text of this id, six words"), (3, filler)]
    found = sorted(tuple(r) for r in decontaminate.contaminated(docs_of(rows), bench).select("doc_id", "item_id", "start_word", "end_word").collect())
    assert found == [(1, 7, 200_000, 200_030), (2, 7, 0, 30), (2, 7, 0, 30)]
    kept = [r["doc_id"] for r in decontaminate.remove_contaminated(docs_of(rows), bench).collect()]
    assert kept == [3]


def test_frequent_partners_are_dealt_out(docs_of, monkeypatch):
    """Chains with one frequent partner give the same spans whole and in groups; repeated rows change nothing."""
    rng = random.Random(31)
    line = _words(rng, 64)
    rows = [(d, " ".join(_words(rng, 30) + _edited(rng, line, d % 2) + _words(rng, 30))) for d in range(24)]
    rows += [rows[3], rows[3]]
    want = sorted(map(str, substring.repeated_spans(docs_of(rows)).collect()))
    assert len(want) == 23
    monkeypatch.setattr(substring, "GROUP", 3)
    assert sorted(map(str, substring.repeated_spans(docs_of(rows)).collect())) == want


def test_pair_chains_equal_joined_matches():
    """Chains of a pair from its two seed lists are those of all equal seeds joined one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    rows, matches = [], []
    for k in range(40):
        h, g = rng.integers(0, 30, rng.integers(1, 40)), rng.integers(0, 30, rng.integers(1, 40))
        pos, at = np.sort(rng.choice(400, len(h), False)), np.sort(rng.choice(400, len(g), False))
        rows.append((100 + k, k, h.tolist(), pos.tolist(), g.tolist(), at.tolist()))
        matches += [(100 + k, k, p, a) for x, p in zip(h, pos) for y, a in zip(g, at) if x == y]
    names = ["doc", "partner", "h", "pos", "g", "at"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    got = [tuple(r.values()) for b in substring._pair_chains(iter([batch])) for r in b.to_pylist()]
    want = [tuple(map(int, c)) for c in substring._chained(*(np.array(c) for c in zip(*matches)))]
    assert got == want and want


def test_runs_of_one_word_pair_documents_only_by_what_is_beside_them(docs_of, monkeypatch):
    rng = random.Random(31)
    rows = []
    for i in range(60):  # a word 40 times between words of the document's own: no passage
        own = _words(rng, 2)
        rows.append((i, " ".join([own[0]] * 30 + ["the"] * 40 + [own[1]] * 30 + _words(rng, 40))))
    for i in (70, 80, 90):  # two runs that are a passage together only
        rows.append((i, " ".join(_words(rng, 40) + ["the"] * 30 + ["is"] * 30 + _words(rng, 40))))
    pairs, save = [], substring.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "pairs":
            pairs.extend((r["doc"], r["partner"]) for r in out.collect())
        return out

    monkeypatch.setattr(substring.Scratch, "save", counted)
    covered = _covered(substring.repeated_spans(docs_of(rows)).collect())
    assert set(covered) == {80, 90} and all(set(range(40, 100)) <= set(covered[d]) for d in covered)
    assert len(pairs) <= 3  # 1,770 documents share the run


def test_shingles_beside_runs_of_one_word():
    # a run, four junctions, another run; the junctions are the rarest
    h = np.array([1] * 40 + [11, 12, 13, 14] + [2] * 40)
    n = np.array([500] * 40 + [9, 8, 7, 6] + [400] * 40)
    flat = np.isin(h, [1, 2])
    # with both runs and three of four junctions a part would be common enough: two must stay
    assert sorted(set(h[substring._beside_runs(h, n, flat)])) == [13, 14]
    # a frequent line near the run is left out, as what nobody else has stands between them
    line = np.arange(20, 29)
    h = np.concatenate((np.arange(100, 140), line, np.arange(300, 304), [1] * 40, np.arange(200, 240)))
    n = np.where(np.isin(h, line), 300, np.where(h == 1, 500, 1))
    assert not substring._beside_runs(h, n, h == 1).any()
    # enough with runs alone: left to the other rule
    assert substring._beside_runs(np.array([1] * 60), np.full(60, 5), np.ones(60, bool)) is None


def test_pairs_of_a_cluster_share_cells(spark):
    """The texts of a pair moved once for every pair: 780 pairs of 40 documents moved 1,560 of them."""
    pairs = [(d, p) for d in range(40) for p in range(d)] + [(100 + d, 50 + d) for d in range(10)]
    cells = substring._cells(spark.createDataFrame(pairs, "doc long, partner long").repartition(5)).collect()
    assert sorted((r["doc"], r["partner"]) for r in cells) == sorted(pairs)
    copies = {(r["cell"], r[c]) for r in cells for c in ("doc", "partner") if r["doc"] < 40}
    assert len(copies) <= 300


def test_cells_give_the_same_spans_whatever_their_size(docs_of, monkeypatch):
    rng = random.Random(8)
    parts = [_words(rng, 60) for _ in range(4)]
    rows = [(d, " ".join(_words(rng, 25) + _edited(rng, parts[d % 4], 4) + _edited(rng, parts[(d + 1) % 4], 6) + _words(rng, 25))) for d in range(30)]
    found = []
    for size in (32, 2, 1):
        monkeypatch.setattr(substring, "CELL", size)
        found.append(sorted(map(str, substring.repeated_spans(docs_of(rows)).collect())))
    assert found[0] and found[1] == found[0] and found[2] == found[0]


def test_pairs_without_common_seeds_have_no_chains():
    import pyarrow as pa

    names = ["doc", "partner", "h", "pos", "g", "at"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in ([2], [1], [[5, 6]], [[0, 9]], [[7]], [[3]])], names=names)
    assert not list(substring._pair_chains(iter([batch])))  # an index error before
