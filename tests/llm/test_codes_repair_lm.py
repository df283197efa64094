"""Vector codes, conversation repair and language-model scoring against brute-force versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import attention as A
from churnlens.llm import lm, repair
from churnlens.llm import vector_codes as V

# ---- vector codes ----------------------------------------------------------
VEC = "vec_id long, embedding array<float>, label int, code string, n int"


def _codes(rows, rounds=V.ROUNDS):
    """The contract, row by row on Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // 4
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:256]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    out, books = [[] for _ in kept], []
    for p in range(4):
        cut = lambda r: r[1][p * d : (p + 1) * d]  # noqa: B023, E731
        book = [cut(r) for r in first]
        near = lambda x: min((dist(x, e), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            groups = collections.defaultdict(list)
            for r in kept:
                groups[near(cut(r))[1]].append(cut(r))
            for k, g in groups.items():
                book[k] = [sum(c) // len(g) for c in zip(*g)]
        books += [x for e in book for x in e]
        for o, r in zip(out, kept):
            o.append(near(cut(r)))
    label = collections.Counter()
    for o, r in zip(out, kept):
        label[r[2]] += sum(e for e, _ in o)
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(
        (repr(r[0]), "".join(f"{k:02x}" for _, k in o), sum(e for e, _ in o), label[r[2]], digest) for o, r in zip(out, kept)
    )


def _coded(df):
    return sorted((repr(r[0]), *r[1:]) for r in V.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_equal_brute_force_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 512], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8, None) for i in range(150)]  # a third is one vector
    bad = [(None, 1), ([], 1), ([None] + [0.0] * 7, 1), ([float("nan")] + [0.0] * 7, 2), ([float("inf")] * 8, 0)]
    rows += [(2000 + i, v, lab) for i, (v, lab) in enumerate(bad)] + [(None, [0.1] * 8, 5)]
    random.Random(1).shuffle(rows)
    want = _codes(rows)
    for parts in (1, 7):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], VEC).repartition(parts)
        assert _coded(df) == want


def test_codes_of_few_rows_other_dimensions_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 1), (2, [0.5] * 4, 1, "", 1), (3, [1.0, 2.5], None, "", 1)], VEC)
    got = {r["vec_id"]: r for r in V.compress(df).collect()}
    assert set(got) == {1, 3}  # the smallest id's dimension counts
    assert got[1]["error"] == 0 and len(got[1]["code"]) == 8
    assert V.compress(df.limit(0)).collect() == []
    big = spark.createDataFrame([(i, [1e30, -1e30, float(i), 0.0], 1, "", 1) for i in range(3)], VEC)
    assert [r["error"] for r in V.compress(big).collect()] == [0, 0, 0]


def test_shortlists_never_lose_the_nearest_entry():
    rng = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 23):
        x = rng.integers(-scale, scale + 1, (500, 5))
        book = rng.integers(-scale, scale + 1, (40, 5))
        book[7] = book[3]
        order, starts, low, high, sums = V.blocks_of(x, 16)
        assert sums.sum(axis=0).tolist() == x.sum(axis=0).tolist()
        kind = V._exact_dtype(book, low, high)
        listed = V.shortlists(book.astype(kind), low.astype(kind), high.astype(kind))
        entry, error = V.nearest_entries(book.astype(kind), x[order].astype(kind), starts, listed)
        d = ((x[order][:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert entry.tolist() == [min(range(40), key=lambda k: (r[k], k)) for r in d]
        assert error.tolist() == [min(r) for r in d]


def test_hilbert_neighbours_are_steps_apart():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    # 3 components get 16 bits; the corners of the grid are 8 apart there, so order the whole cube
    v = side[np.argsort(V.hilbert_keys(side))]
    steps = np.abs(np.diff(v, axis=0)).sum(axis=1)
    assert len({tuple(r) for r in v.tolist()}) == 512 and steps.mean() < 1.6


# ---- conversation repair ----------------------------------------------------
CHAT = "conv_id long, turn long, role string, text string, gaps long, audit string"
KINDS = "xsuaoSUAO"


def _full(kinds):
    """Every division of every span."""
    n = len(kinds)
    table = {(i, i + 1): repair._row(k) for i, k in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells = [None] * 16
            for m in range(i + 1, i + length):
                for at, c in enumerate(repair._product(table[i, m], table[m, i + length])):
                    cells[at] = c if cells[at] is None else cells[at] if c is None else min(cells[at], c)
            table[i, i + length] = tuple(cells)
    return repair.best(table[0, n])


def _edits(kinds):
    """Every choice of edits, up to two Inserts a gap."""
    best = None
    for choice in itertools.product(*[_options(k) for k in kinds]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(kinds) + 1):
            line, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for (c, letter, initial), gap in zip(choice, gaps[1:]):
                line, audit, cost = line + initial + gap, audit + letter + "I" * len(gap), cost + c + 5 * len(gap)
            if re.fullmatch("(s?(ua)+)?", line) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def _options(kind):
    out = [(2, "D", "")]
    if kind != "x":
        more = 5 if kind.isupper() else 0
        out += [(more, "K", kind.lower())] if kind.lower() in "sua" else []
        out += [(1 + more, "R", "u"), (1 + more, "R", "a")]
    return out


def test_spans_equal_all_edits_and_all_divisions():
    rng = random.Random(2)
    for n in (1, 2, 3):
        every = list(itertools.product(KINDS, repeat=n))
        for kinds in map("".join, every if n < 3 else rng.sample(every, 40)):
            assert repair.best(repair.parse(kinds)) == _edits(kinds)
    for _ in range(60):
        kinds = "".join(rng.choices(KINDS, k=rng.randint(4, 70)))
        assert repair.best(repair.parse(kinds)) == _full(kinds)


def _same(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.execute(repair.REPAIR_SQL)
    cols = [c[0] for c in rel.description]
    got = repair.repair(spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT).repartition(5))
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    return got


def test_repair_equals_sql_on_nulls_copies_and_odd_roles(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", None, "", "tool", "s", "User"]
    texts = [None, "", "hi.", "hi", "Yes! ", "no\n", "x?\t", "  ", " "]
    rows = [(rng.choice([1, 2, 3, 4, None, 50]), rng.choice([None, *range(20)]), rng.choice(roles), rng.choice(texts)) for _ in range(250)]
    rows += [(77, 1, "user", "same.")] * 400 + [(77, 2, "assistant", "same.")] * 3 + [(77, 3, "user", "same.")]
    _same(spark, rows)
    _same(spark, [])


def test_a_long_conversation_is_cut_into_ranges_and_joined(spark):
    rng = random.Random(6)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}."])) for t in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        _same(spark, rows + [(1, 0, "user", "q."), (1, 1, "assistant", "very long. " * 50_000)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# ---- language model ----------------------------------------------------------
def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    share = rng.random((A.CLASSES, A.MEMBERS)) + 0.1
    p = A.initial(np.full(A.CLASSES + 1, 1 / (A.CLASSES + 1)), share / share.sum(axis=1, keepdims=True))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    p["near"] += rng.standard_normal(p["near"].shape)
    ids, target = rng.integers(0, A.RANKS + 2, (3, A.LENGTH)), rng.integers(0, A.RANKS + 1, (3, A.LENGTH))
    weight = (rng.random((3, A.LENGTH)) < 0.8).astype(float)
    _, g = A.loss_and_gradient(p, ids, target, weight)
    for name, w in p.items():
        flat, most = w.reshape(-1), np.argsort(-np.abs(g[name].reshape(-1)))[:3]
        for i in most:
            old, ends = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                ends.append(A.loss_and_gradient(p, ids, target, weight)[0])
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=2e-3, abs=1e-7), name


def _plain(p, rank, first):
    """Log probabilities id by id: each sees its window's earlier ids only."""
    out = []
    for a, b in zip(first[:-1], first[1:]):
        r, total = rank[a:b], 0.0
        seen = [A.START, *r[:-1].tolist()]
        for i in range(len(r)):
            start = 0 if i < A.LENGTH else lm.STRIDE * (1 + (i - A.LENGTH) // lm.STRIDE)
            x = np.stack([p["token"][t] + p["place"][j] for j, t in enumerate(seen[start : i + 1])])
            q, k, v = np.split(x @ p["qkv"], 3, axis=1)
            s = k @ q[-1] * A.WIDTH**-0.5 + p["near"][0, : len(x)][::-1]
            w = np.exp(s - s.max())
            y = x[-1] + (w / w.sum()) @ v @ p["out"]
            z = y + np.maximum(y @ p["up"] + p["up0"], 0) @ p["down"]
            soft = lambda m: m - np.log(np.exp(m).sum())
            c = min(r[i] // A.MEMBERS, A.CLASSES)
            total += soft(z @ p["class"] + p["class0"])[c]
            if c < A.CLASSES:
                total += soft(z @ p["member"][c] + p["member0"][c])[r[i] % A.MEMBERS]
        out.append(total)
    return out


def test_windows_score_each_id_once_under_the_causal_mask():
    rng = np.random.default_rng(2)
    share = rng.random((A.CLASSES, A.MEMBERS)) + 0.1
    p = A.initial(np.full(A.CLASSES + 1, 1 / (A.CLASSES + 1)), share / share.sum(axis=1, keepdims=True))
    p["near"] += rng.standard_normal(p["near"].shape).astype(np.float32)
    sizes = [1, 2, A.LENGTH - 1, A.LENGTH, A.LENGTH + 1, A.LENGTH + lm.STRIDE, A.LENGTH + lm.STRIDE + 1, 200]
    first = np.concatenate(([0], np.cumsum(sizes)))
    rank = rng.integers(0, A.RANKS + 1, first[-1])
    assert lm.score_ids(A.Scorer(p), rank, first) == pytest.approx(_plain(p, rank, first), rel=1e-4)


LM = dict(warm=300, group=400, least=600)


def _docs(docs_of, n=160):
    rng = random.Random(8)
    words = ["the", "cat", "sat", "on", "mats", "and", "dogs", "ran", "far", "Away", "zebra"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 12), k=rng.randint(1, 60)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "the cat"), (5, "the cat sat"), (5, "the cat sat"), (903, "unseen Ünseen  x " * 9000), (904, "\x00 <s> </s> <unk>")]
    return rows, docs_of(rows)


def test_language_model_on_odd_texts_with_exact_baseline(spark, docs_of, monkeypatch):
    rows, docs = _docs(docs_of)
    monkeypatch.setattr(lm, "FREQUENT", 6)  # most words go through the join with the counts
    got = lm.language_model(docs.repartition(3), **LM).collect()
    assert len(got) == len(rows)
    text = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = collections.Counter(w for d, t in rows if not held(d) for w in text(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), held(d), len(text(t)), sum(w in counts for w in text(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in text(t)), 6))
        for d, t in rows
    )
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(round(r["score"], 4))
    assert len(by_id[5]) <= 2 and by_id[901] == by_id[902] == by_id[900]  # equal texts, equal scores


def test_language_model_without_rows_or_training_rows(spark, docs_of):
    assert lm.language_model(docs_of([(0, "a")]).limit(0), **LM).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.language_model(docs_of([(only, "a b")]), **LM).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0 and math.isfinite(r["score"])


def test_language_model_learns_order_and_holds_out(spark):
    """Held-out texts of the small corpus are likelier than under the untrained model and in shuffled word order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = lm.language_model(docs, least=12_000)
    plain = lm.language_model(docs, rounds=0, warm=0)
    total = lambda df: df.where("held_out").agg(F.sum("score").alias("s")).first()["s"]
    assert total(own) > 0.85 * total(plain)
    assert own.where("score >= 0").count() == 0 and own.count() == docs.count()


def test_every_training_id_is_a_target_once_and_every_window_is_trained_on(spark, docs_of, monkeypatch):
    """No id of a training text is left to chance: one window in ten was drawn before."""
    rows, docs = _docs(docs_of)
    model = Path(lm.TOKENIZER).read_bytes()
    split = lm.Subwords(model)
    rank = np.arange(split.size) % A.RANKS
    windows = lm._windows(docs, model, rank).withColumn("at", F.monotonically_increasing_id()).cache()
    got = np.stack([np.frombuffer(r["ids"], np.int16) for r in windows.collect()]).astype(np.int64)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want, starts = collections.Counter(), 0
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            ids = [int(rank[i]) for g in split.ids_of(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))) for i in g] + [int(rank[split.ids[0]])]
            want.update(zip([A.START, *ids], ids))
            starts += 1
    assert collections.Counter(map(tuple, np.stack((got[:, :-1], got[:, 1:]), axis=2)[got[:, 1:] >= 0].tolist())) == want
    assert (got == A.START).sum() == starts
    trained = collections.Counter()

    def seen(w, p, *_):
        trained.update((r["key"], r["at"]) for r in w.select("key", "at" if "at" in w.columns else F.lit(-1).alias("at")).collect())
        return None

    monkeypatch.setattr(lm, "_replicas", seen)
    monkeypatch.setattr(lm, "_average", lambda rows, p: p)
    lm.train(windows, {}, len(got), warm=0, group=200, least=1)
    keys = collections.Counter(r["key"] for r in windows.select("key").collect())
    assert collections.Counter(k for k, _ in trained.elements()) == keys
