"""Toxicity by a weighted finite-state pattern grammar over clauses.

Method: small transducers read a clause's tokens by class and are composed
into one deterministic machine.  The insult transducer emits a match at a word
of the lexicon.  The threat transducer emits one where a whole threat has been
read: an announcing speaker (``I will``, ``voy a``), a verb of harm and an
addressed person or that person's kin beside it; an order to harm oneself; or
an addressed person whom a modal and a passive put under the verb (``you will
be shot``).  A verb of harm alone emits nothing.  The negation transducer lowers
what follows a negation (matches within two tokens, threats announced after
it), the reported-speech transducer lowers what follows a speech verb in the
clause, the target transducer raises insults near an addressed person (before
or after).  A clause scores the sum of its emitted weights; a document is scored
from its best clause, the sum over clauses and the number of matched clauses
through a logistic layer.

The words of all classes but the insults are fixed lists.  The insult lexicon and its weights (words and word beginnings,
so that productive compounds are covered) are learned from the labelled rows,
as smoothed log odds of a term's document frequencies that must clear a
confidence bound.  A threat weighs as much as the lexicon's median term (with
no lexicon ``THREAT_WEIGHT``).  Near copies among the training rows count once.  The
logistic layer is fitted on rows that the lexicon has not seen.

Bounds: training reads at most about ``TRAIN_ROWS`` labelled rows (chosen by
id hash); the lexicon, at most what those rows hold, goes to all tasks.
Scoring reads every text whole, in one narrow map.

Defined cases: null and empty texts have no match and get the score of a text
without any; labels that are null are ignored, and of several labels of one
doc_id the larger counts; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from churnlens.llm import text as T
from churnlens.llm.common import crc_fold
from churnlens.session import ship_package

TRAIN_ROWS = 24_000
FOLDS = 5
PREFIX_BYTES = (4, 5, 6, 7, 8)
MIN_LOWER_ODDS = 2.2
MIN_DOCS = 5

# Words of the grammar's closed classes, in four languages.
YOU = "you you're u du dich dir ihr euch sie te toi vous tú ti tu usted ustedes vosotros".split()
YOUR = "your yours dein deine ton ta votre".split()
SELF = "yourself yourselves".split()
KIN = "family kids children wife husband mother father brother sister son daughter house home familie kinder famille enfants maison familia hijos casa".split()
VERB = "kill killed hurt destroy burn burned shoot shot stab stabbed beat beaten töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
SPEAKER = "i we ich wir je nous yo nosotros".split()
MODAL = "will shall would must should could can may might gonna going want need deserve werden".split()
INTENT = "i'll we'll i'd we'd i'm we're werde vais allons voy vamos".split()
PASSIVE = "be get being getting".split()
GO = "go just please now to a and all both of every one".split()
NEGATION = "not no never don't isn't aren't won't can't nobody nicht kein keine nie ne pas jamais non ni nunca jamás".split()
REPORTED = "said says say told called quoted wrote sagte sagt nannte schrieb dit disait écrit dijo dice llamó escribió".split()

SYMBOLS = range(14)
OTHER, INSULT, HARMS, TARGETS, OWNS, REFLECTS, RELATES, NEGATES, REPORTS, SPEAKS, WILLS, INTENDS, SUFFERS, LINKS = SYMBOLS
ADDRESSED = (TARGETS, OWNS, REFLECTS)
THREAT_WEIGHT = 4.0
NEGATED, QUOTED, AIMED = 0.25, 0.4, 0.5  # factors of a match's weight; AIMED is added


def _machine(start, step):
    """A transducer as tables next[state, symbol] and out[state, symbol]; ``step(state, symbol)`` gives (state, output)."""
    number, rows = {start: 0}, []
    for state in (found := [start]):
        rows.append([step(state, x) for x in SYMBOLS])
        for s, _ in rows[-1]:
            if s not in number:
                number[s] = len(found)
                found.append(s)
    return np.array([[number[s] for s, _ in r] for r in rows]), np.array([[o for _, o in r] for r in rows], dtype=float)


def _compose(parts):
    """Product machine over the states reached: runs all transducers side by side, an output column for each."""
    number, nxt, out = {(0,) * len(parts): 0}, [], []
    for state in (found := list(number)):
        row = []
        for x in SYMBOLS:
            to = tuple(int(p[0][s, x]) for p, s in zip(parts, state))
            if to not in number:
                number[to] = len(found)
                found.append(to)
            row.append(number[to])
        nxt.append(row)
        out.append([[p[1][s, x] for p, s in zip(parts, state)] for x in SYMBOLS])
    return np.array(nxt), np.array(out)


def _threat_step(state, x):
    """Active threats: (words since the announcement began, announced, denied, what stands last)."""
    since, announced, denied, last = state
    out = 0.0
    if announced:
        # verb + person, verb + "your" + kin, or person + verb where the person stands beside the announcement
        done = (last == "verb" and x == TARGETS) or (last == "verb your" and x == RELATES) or (last in ("person first", "person") and x == HARMS)
        out = (NEGATED if denied else 1.0) * done
    if x == HARMS:
        last = "verb"
    elif x == OWNS and last == "verb":
        last = "verb your"
    elif x == TARGETS:
        last = "person" if last == "intent" else "addressed"
    elif x == INTENDS:
        last = "person first" if last == "addressed" else "intent"
    elif x != LINKS or last not in ("verb", "person first", "person", "intent"):
        last = ""
    if x == SPEAKS:
        return (1, announced, False if not announced else denied, last), out
    if x == INTENDS or x == WILLS and since:
        return (0, True, denied, "intent" if x == WILLS else last), out
    return ((since + 1) % 4 if since else 0, announced, denied or x == NEGATES, last), out


def _order_step(state, x):
    """Orders to harm oneself: a clause that begins with the verb (or ``go``, ``please`` ... and the verb)."""
    if state == "verb" and x == REFLECTS:
        return "", 1.0
    return ("start" if state == "start" and x == LINKS else "verb" if state == "start" and x == HARMS else ""), 0.0


def _passive_step(state, x):
    """A person, modals, a passive and the verb: ``you will be shot``."""
    place, denied = state
    if place == "passive" and x == HARMS:
        return ("", False), NEGATED if denied else 1.0
    if x == TARGETS:
        return ("person", False), 0.0
    if place in ("person", "modal") and x in (WILLS, NEGATES, LINKS):
        return ("modal" if x == WILLS else place, denied or x == NEGATES), 0.0
    return ("passive" if place == "modal" and x == SUFFERS else "", denied), 0.0


_insult = _machine(0, lambda s, x: (0, x == INSULT))
_threat = _machine((0, False, False, ""), _threat_step)
_order = _machine("start", _order_step)
_passive = _machine(("", False), _passive_step)
_negation = _machine(0, lambda s, x: (2 if x == NEGATES else max(0, s - 1), NEGATED if s else 1.0))
_reported = _machine(0, lambda s, x: (int(s or x == REPORTS), QUOTED if s else 1.0))
_before = _machine(0, lambda s, x: (3 if x in ADDRESSED else max(0, s - 1), 1 + AIMED if s else 1.0))
PARTS = (_insult, _threat, _order, _passive, _negation, _reported, _before)
#: Composed grammar and its two outputs; a target that follows an insult is added by ``_after``.
NEXT, _OUTS = _compose(PARTS)
OUT = _OUTS[:, :, 0] * _OUTS[:, :, 4] * _OUTS[:, :, 5] * _OUTS[:, :, 6]
THREATS = (_OUTS[:, :, 1] + _OUTS[:, :, 2] + _OUTS[:, :, 3]) * _OUTS[:, :, 5]
_after = _machine(0, lambda s, x: (3 if x == INSULT else max(0, s - 1), AIMED if s and x in ADDRESSED else 0.0))

_SEPARATE = np.zeros(256, bool)
_SEPARATE[[*range(0x00, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".!?;\n")] = True


def _hash_list(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        x = T.words_of(raw, np.array([0, len(raw)]), np.zeros(256, bool))
        out.append(x.hashes()[0])
    return np.array(out, np.uint64)


CLOSED = {
    k: _hash_list(v)
    for k, v in (
        (TARGETS, YOU), (OWNS, YOUR), (REFLECTS, SELF), (RELATES, KIN), (HARMS, VERB), (SPEAKS, SPEAKER), (WILLS, MODAL), (INTENDS, INTENT),
        (SUFFERS, PASSIVE), (LINKS, GO), (NEGATES, NEGATION), (REPORTS, REPORTED),
    )
}


def _terms(x: T.Words):
    """Yield (words, hashes) of whole words and of their beginnings."""
    yield np.arange(len(x.start)), x.hashes()
    length = x.end - x.start
    for n in PREFIX_BYTES:
        at = np.flatnonzero(length > n)
        # another length salt keeps a beginning apart from a word of the same bytes
        yield at, T.mix64(x.span_hash(x.start[at], x.start[at] + n) ^ np.uint64(0xB5297A4D3F84D5A7))


class Lexicon:
    """Sorted term hashes with weights and a bitmap that rejects most words at once."""

    BITS = 20

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.threat = float(np.median(weights)) if len(weights) else THREAT_WEIGHT
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(terms >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, weights) of the hashes that are terms."""
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        ok = self.terms[at] == hashes[maybe]
        return maybe[ok], self.weights[at[ok]]


_CLOSED_LEX = Lexicon(
    np.concatenate(list(CLOSED.values())), np.concatenate([np.full(len(v), float(k)) for k, v in CLOSED.items()])
)


def clause_scores(x: T.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of every clause with a match."""
    weight = np.zeros(len(x.start))
    whole = None
    for at, h in _terms(x):
        whole = h if whole is None else whole
        if len(lexicon.terms):
            pos, w = lexicon.weigh(h)
            np.maximum.at(weight, at[pos], w)
    if whole is None or not len(whole):
        return np.zeros(0, int), np.zeros(0)
    symbol = np.zeros(len(x.start), int)
    pos, kind = _CLOSED_LEX.weigh(whole)
    symbol[pos] = kind.astype(int)
    symbol[weight > 0] = INSULT
    hit = np.flatnonzero((symbol == INSULT) | (symbol == HARMS))
    if not len(hit):
        return np.zeros(0, int), np.zeros(0)
    doc = np.searchsorted(x.first, np.arange(len(x.start)), "right") - 1
    ends = np.concatenate(([0], np.cumsum(_CLAUSE[x.data])))[x.start]
    clause = ends + doc  # a new document is a new clause as well
    new = np.flatnonzero(np.diff(clause, prepend=clause[0] - 1))
    which = np.unique(np.searchsorted(new, hit, "right") - 1)
    bounds = np.append(new, len(clause))
    docs, scores = [], []
    for c in which:
        a, b = bounds[c], bounds[c + 1]
        state, pending, total, last = 0, 0, 0.0, 0.0
        for i in range(a, b):
            s = symbol[i]
            total += weight[i] * OUT[state, s] + lexicon.threat * THREATS[state, s]
            total += last * _after[1][pending, s]
            last = weight[i] if s == INSULT else last
            state, pending = NEXT[state, s], _after[0][pending, s]
        if total:
            docs.append(doc[a])
            scores.append(total)
    return np.array(docs, int), np.array(scores)


N_FEATURES = 3


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Per document: best clause, log of the sum over clauses, log of their number."""
    n = len(offsets) - 1
    best, total, count = np.zeros(n), np.zeros(n), np.zeros(n)
    doc, score = clause_scores(T.words_of(data, offsets, _SEPARATE), lexicon)
    np.maximum.at(best, doc, score)
    np.add.at(total, doc, score)
    np.add.at(count, doc, 1)
    return np.column_stack((best, np.log1p(total), np.log1p(count)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """At most about ``rows`` labelled training rows ``doc_id, text, y, part`` (by id hash; part 0..9)."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(keep)
    total = known.count()
    share = 1.0 if total <= rows else rows / total
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1.0)))
    # at most about ``rows`` rows of two numbers: bounded by the parameter
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10)).cast("int"))


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of those that share the least or the greatest shingle hash (near copies mostly do)."""

    def run(batches):
        for b in batches:
            for i, j, data, offsets in T.text_chunks(b.column("text")):
                x = T.words_of(data, offsets)
                sh, off = T.shingles_of(x.hashes(), x.first)
                has = np.flatnonzero(np.diff(off))
                low, high = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(has):
                    low[has] = np.minimum.reduceat(sh, off[:-1][has])
                    high[has] = np.maximum.reduceat(sh, off[:-1][has])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=[*part.schema.names, "low", "high"]
                )

    marked = sample.select("doc_id", "text", "y", "part").mapInArrow(run, "doc_id long, text string, y int, part int, low long, high long")
    row = F.struct("doc_id", "text", "y", "part", "high")
    once = marked.groupBy("low").agg(F.min(row).alias("r")).select("r.*")
    return once.groupBy("high").agg(F.min(F.struct("doc_id", "text", "y", "part")).alias("r")).select("r.*")


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Term weights from document frequencies in ``train(text, y)``."""

    def run(batches):
        for b in batches:
            y = b.column("y").to_numpy()
            for i, j, data, offsets in T.text_chunks(b.column("text")):
                x = T.words_of(data, offsets, _SEPARATE)
                doc = x.doc.astype(np.uint64)
                at = np.concatenate([d[a] for d, (a, _) in zip([doc] * (1 + len(PREFIX_BYTES)), _terms(x))]) if len(doc) else np.zeros(0, np.uint64)
                h = np.concatenate([h for _, h in _terms(x)]) if len(doc) else np.zeros(0, np.uint64)
                order = np.lexsort((at, h))
                h, at = h[order], at[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
                h, at = h[new], at[new]
                terms, start = np.unique(h, return_index=True)
                if not len(terms):
                    continue
                one = np.add.reduceat((y[i:j][at.astype(np.int64)] > 0).astype(np.int64), start)
                n = np.diff(np.append(start, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(one), pa.array(n - one)], names=["term", "n1", "n0"])

    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for y, n in size.items() if y > 0), sum(n for y, n in size.items() if y <= 0)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if not n1 or not n0:
        return empty
    counts = train.select("text", "y").mapInArrow(run, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, c = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n1 + 1)) - F.log(c / (n0 + 1))
    rows = (
        counts.where(F.col("n1") >= MIN_DOCS)
        .select("term", (odds - 1.64 * F.sqrt(1 / a + 1 / c)).alias("w"))
        .where(F.col("w") >= MIN_LOWER_ODDS)
        .toPandas()
    )
    if not len(rows):
        return empty
    return Lexicon(rows["term"].to_numpy(np.int64).view(np.uint64), rows["w"].to_numpy(float))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps for a logistic layer with intercept (last weight)."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon and logistic layer; what the scoring tasks receive."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(offsets) - 1)
        x = features(data, offsets, self.lexicon)
        z = np.column_stack((x, np.ones(len(x)))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = 0, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows whose crc32 fold is not ``held_out``."""
    sample = labelled_sample(docs, labels, "toxic", crc_fold("doc_id", folds) != held_out, rows)
    sample = without_copies(sample).persist()
    try:
        lexicon = learn_lexicon(sample.where("part < 7"))

        def run(batches):
            for b in batches:
                for i, j, data, offsets in T.text_chunks(b.column("text")):
                    x = features(data, offsets, lexicon)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column("y").slice(i, j - i), flat], names=["y", "x"])

        seen = sample.where("part >= 7").select("text", "y").mapInArrow(run, "y int, x array<double>").toPandas()
    finally:
        sample.unpersist()
    y = (seen["y"].to_numpy() > 0).astype(float) if len(seen) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    return Model(lexicon, fit_logistic(np.stack(seen["x"].to_numpy()), y))


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` plus a score of its whole ``text`` (one narrow map)."""
    name = "__text"
    schema = docs.schema
    ship_package(docs.sparkSession)
    x = docs.withColumn(name, F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i, j, data, offsets in T.text_chunks(b.column(name)):
                s = shared.value.score(data, offsets)
                part = b.drop_columns([name]).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, column])

    kept = [f for f in schema.fields if f.name != column]
    x = x.drop(column) if column in docs.columns else x
    return x.mapInArrow(run, P.StructType([*kept, P.StructField(column, P.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
