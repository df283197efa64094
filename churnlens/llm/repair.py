"""Conversation structure repair: weighted CYK parsing of a conversation's rows as spans.

Method: a repair grammar in Chomsky normal form derives every row sequence
whose repaired role initials read ``(s?(ua)+)?``.  Its nonterminals are pairs
``(p, q)`` of states of that pattern: ``(p, q)`` derives a span whose repaired
rows lead from ``p`` to ``q``; the binary rules are ``(p, q) -> (p, r) (r, q)``
and the terminal rules are the edits of one row (Keep, Rerole, Delete).  A cell
holds the least ``(cost, audit)`` of its nonterminal over its span, after the
insertion closure (Inserts before and behind it).  Spans are combined bottom-up
by length, 1, 2, 4, ...: every derivation is in some state between two given
rows, so with these nonterminals one division of a span finds what all
divisions would, and the table has two spans a row instead of all of them.  Two
audits of one span and equal cost never extend each other (they hold one
letter a row besides Inserts, and Inserts cost), so the least string of a whole is made
of the least strings of its parts.

Distribution: only a digest of each text and its flags are sorted, by
conversation and turn, in ranges (equal rows are one row with a count, so no
group of copies is one task).  A range parses its rows as a stream; a
conversation that crosses ranges leaves one table of 16 cells a range, and these are
combined in order.  Duplicates are found by one row per repeated role and text,
joined back with the frequent ones broadcast (there are at most ``HOT``).  The
digest of the repaired text is sequential by its definition: rows are streamed
by conversation with bounded memory and the audit at hand.

Defined cases: a null role, text, conv_id or turn counts as one space where it
is text (also in the damage key); rows of equal turn go by role, then by the digest of their text;
null conv_ids are one conversation; a role whose initial is none of s, u, a
cannot be kept; an empty table gives an empty result; columns beyond conv_id,
turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch, lookup
from churnlens.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of the pattern: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
STATES = 4

Cell = tuple[int, str] | None


def _product(left: tuple[Cell, ...], right: tuple[Cell, ...]) -> tuple[Cell, ...]:
    """Cells of a span from those of its two parts: (p, q) -> (p, r) (r, q)."""
    out: list[Cell] = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            a = left[p * STATES + r]
            if a is None:
                continue
            for q in range(STATES):
                b = right[r * STATES + q]
                if b is None:
                    continue
                cost, at = a[0] + b[0], p * STATES + q
                held = out[at]
                if held is None or cost < held[0] or (cost == held[0] and a[1] + b[1] < held[1]):
                    out[at] = (cost, a[1] + b[1])
    return tuple(out)


def _insertions() -> tuple[Cell, ...]:
    """Cells of the empty span: Inserts only (of user and assistant rows), closed under succession."""
    one: list[Cell] = [None] * (STATES * STATES)
    for p in range(STATES):
        one[p * STATES + p] = (0, "")
    for (p, initial), q in MOVES.items():
        if initial in "ua" and p != q:
            one[p * STATES + q] = (INSERT, "I")
    closed = tuple(one)
    for _ in range(STATES):
        closed = _product(closed, tuple(one))
    return closed


EMPTY = _insertions()


@lru_cache(maxsize=64)
def _row(kind: str) -> tuple[Cell, ...]:
    """Cells of one row.  ``kind``: x must go; s, u, a, o name the role's initial, in capitals where the text is cut short."""
    base: list[Cell] = [None] * (STATES * STATES)

    def put(p: int, q: int, cell: tuple[int, str]) -> None:
        at = p * STATES + q
        base[at] = cell if base[at] is None else min(base[at], cell)

    for p in range(STATES):
        put(p, p, (DELETE, "D"))
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        for (p, initial), q in MOVES.items():
            if initial == kind.lower():
                put(p, q, (KEEP + more, "K"))
            if initial in "ua":
                put(p, q, (REROLE + more, "R"))
    return _product(_product(EMPTY, tuple(base)), EMPTY)


def _span(kinds: str) -> tuple[Cell, ...]:
    if len(kinds) == 1:
        return _row(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    part = _short if half <= 32 else _span
    return _product(part(kinds[:half]), (_short if len(kinds) - half <= 32 else _span)(kinds[half:]))


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> tuple[Cell, ...]:
    return _span(kinds)


def parse(kinds: str) -> tuple[Cell, ...]:
    """Cells of a span of rows; spans of up to 32 rows are remembered, since conversations resemble each other."""
    if not kinds:
        return EMPTY
    return _short(kinds) if len(kinds) <= 32 else _span(kinds)


def best(cells: tuple[Cell, ...]) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min(cells[q] for q in ACCEPTED if cells[q] is not None)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of every row after the damage (copies 0: dropped)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(said("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _lines(damaged: DataFrame) -> DataFrame:
    """Equal rows as one, with the text's digest and faults instead of the text."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    keys = ["conv_id", "turn", "role", "key"]
    marked = damaged.select(*keys[:3], F.unhex(F.sha2("text", 256)).alias("key"), blank.alias("blank"), cut.alias("cut"), "copies")
    return marked.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))


def _order() -> list:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]


def _faults(lines: DataFrame) -> DataFrame:
    """Present lines with ``later``: whether role and text were seen at an earlier turn."""
    here = lines.where("copies > 0").withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    again = here.groupBy("conv_id", "role", "key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = here.count()
    found = lookup(here, again, ["conv_id", "role", "key"], "n", total)
    return found.withColumn("later", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("place", "first", "n")


PIECE = "conv_id long, range int, whole boolean, head string, tail string, illegal long, costs array<long>, audits array<string>"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Piece:
    """Consecutive rows of one conversation: spans as a stack of falling lengths, merged when equal."""

    def __init__(self, conv):
        self.conv, self.head, self.tail, self.illegal = conv, None, None, 0
        self.kinds: list[str] = []
        self.spans: list[tuple[int, tuple[Cell, ...]]] = []

    def add(self, initial: str, kinds: str) -> None:
        if self.head is None:
            self.head = initial
        elif (self.tail, initial) not in LEGAL:
            self.illegal += 1
        if (initial, initial) not in LEGAL:
            self.illegal += len(kinds) - 1
        self.tail = initial
        self.kinds.append(kinds)
        if len(self.kinds) == 1024:
            self._fold()

    def _fold(self) -> None:
        text = "".join(self.kinds)
        self.kinds = []
        self.spans.append((len(text), parse(text)))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            (n, b), (m, a) = self.spans.pop(), self.spans.pop()
            self.spans.append((n + m, _product(a, b)))

    def cells(self) -> tuple[Cell, ...]:
        if self.kinds or not self.spans:
            self._fold()
        out = self.spans[-1][1]
        for _, a in reversed(self.spans[:-1]):
            out = _product(a, out)
        return out


def _pieces(faulty: DataFrame) -> DataFrame:
    """Ranges of rows in order -> one row per conversation and range; all but a range's outer two are whole."""
    kind = F.when(F.col("blank") | F.col("later"), F.lit("x")).otherwise(
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("o"))
    )
    kind = F.when(F.col("cut"), F.upper(kind)).otherwise(kind)
    kind = F.when(kind == "X", F.lit("x")).otherwise(kind)
    rows = faulty.withColumn("kind", kind).withColumn("initial", F.substring("role", 1, 1))
    rows = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "initial", "kind", "copies")

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        piece, first, out = None, True, []

        def close(p, whole):
            cells = p.cells()
            if whole:
                cells = [best(cells)]
            costs = [None if c is None else c[0] for c in cells]
            out.append((p.conv, at, whole, p.head, p.tail, p.illegal, costs, [None if c is None else c[1] for c in cells]))

        def batch():
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            names = ["conv_id", "range", "whole", "head", "tail", "illegal", "costs", "audits"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for b in batches:
            for conv, initial, k, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        close(piece, not first)
                        first = False
                    piece = _Piece(conv)
                piece.add(initial, k + "x" * (n - 1))
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if piece is not None:
            close(piece, False)
        if out:
            yield batch()

    return rows.mapInArrow(run, PIECE)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, illegal, cost, audit``; pieces of several ranges are combined in order."""
    done = pieces.where("whole").select("conv_id", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    outer = pieces.where("not whole").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("range", "head", "tail", "illegal", "costs", "audits"))).alias("parts")
    )

    def run(batches):
        for b in batches:
            convs, illegal, found = [], [], []
            for conv, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist()):
                bad, tail = 0, None
                level = []
                for i, p in enumerate(parts):
                    bad += p["illegal"] + (1 if i and (tail, p["head"]) not in LEGAL else 0)
                    tail = p["tail"]
                    level.append(tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])))
                while len(level) > 1:
                    level = [_product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                convs.append(conv)
                illegal.append(bad)
                found.append(best(level[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.int64()), pa.array(illegal, pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=["conv_id", "illegal", "cost", "audit"],
            )

    return done.unionByName(outer.mapInArrow(run, "conv_id long, illegal long, cost long, audit string"))


def repaired(kinds_audit: str, rows) -> list[tuple[str, str]]:
    """(role, text) of a conversation after its audit; ``rows`` yields the damaged (role, text) in order."""
    return list(_edit(iter(kinds_audit), rows))


def _edit(letters, rows):
    """Applies letters to rows as a stream; a Delete yields nothing."""
    n = 0  # repaired rows so far, a kept system row not counted

    def role() -> str:
        return "assistant" if n % 2 else "user"

    for said, text in rows:
        letter = next(letters)
        while letter == "I":
            yield role(), ""
            n += 1
            letter = next(letters)
        if letter == "K":
            yield said, text
            n += 0 if said.startswith("s") else 1
        elif letter == "R":
            yield role(), text
            n += 1
    for _ in letters:  # Inserts at the end
        yield role(), ""
        n += 1


HEAD = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _digested(heads: DataFrame, damaged: DataFrame) -> DataFrame:
    """Heads with the digest of the repaired text: each conversation's head, then its rows in order, as one stream."""
    rows = damaged.where("copies > 0").withColumn("key", F.unhex(F.sha2("text", 256)))
    names = [c.split()[0] for c in HEAD.split(", ")][1:]
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in HEAD.split(", ")][1:]
    both = heads.select(
        "conv_id", F.lit(0).alias("sort"), *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "conv_id"), *names
    ).unionByName(rows.select("conv_id", F.lit(1).alias("sort"), *(c for c in rows.columns if c != "conv_id"), *blank))
    order = [F.col("conv_id").asc_nulls_first(), F.col("sort"), *_order()[1:]]
    stream = both.repartition("conv_id").sortWithinPartitions(*order).drop("turn", "key")

    def run(batches):
        import itertools

        def lines():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "sort", "role", "text", "copies", *names)))

        def texts(group):
            for x in group:
                for _ in range(x[4]):
                    yield x[2], x[3]

        out = []
        for _, group in itertools.groupby(lines(), key=lambda x: x[0]):
            head = next(group)
            digest = hashlib.sha256()
            for i, (role, text) in enumerate(_edit(iter(head[-1]), texts(group))):
                digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            out.append((head[0], *head[5:], digest.hexdigest()))
            if len(out) == 4096:
                yield _heads_batch(out)
                out = []
        if out:
            yield _heads_batch(out)

    return stream.mapInArrow(run, HEAD + ", repaired_sha256 string")


def _heads_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in HEAD.split(", ")] + ["repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def repair(rows: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """Faults, least edits and repaired digest of every conversation of ``rows`` (``damaged``: the rows as ``damage`` gives them)."""
    spark = rows.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "repair")
    damaged = damage(rows) if damaged is None else damaged
    lines = scratch.save(_lines(damaged), "lines")
    faulty = scratch.save(_faults(lines), "faulty")
    pieces = scratch.save(_pieces(faulty), "pieces")
    again = F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("later"), 0).otherwise(1))
    by_turn = faulty.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(again).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("later") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    known = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    stats = by_turn.groupBy("conv_id").agg(
        F.coalesce(known, F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    names = lines.select("conv_id").distinct()
    s, p, n = stats.alias("s"), _joined(pieces).alias("p"), names.alias("n")
    heads = n.join(s, F.col("n.conv_id").eqNullSafe(F.col("s.conv_id")), "left").join(
        p, F.col("n.conv_id").eqNullSafe(F.col("p.conv_id")), "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[1])
    heads = heads.select(
        "n.conv_id",
        *(zero(c) for c in ("s.gaps", "s.blank", "s.duplicate", "s.truncated", "p.illegal", "p.cost")),
        F.coalesce(F.col("p.audit"), F.lit("")).alias("audit"),
    )
    return _digested(heads, damaged)


#: The same repair in DuckDB SQL, row by row instead of by spans: ``best`` keeps, for every state, the least
#: (cost, audit) behind each row; ``gap`` lists what Inserts can do between two rows.
REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hit AS (
  SELECT said.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM said, crc_table),
damaged AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) AS c(i) WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
         left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
faults AS MATERIALIZED (
  SELECT conv_id, n, turn, role, text, initial,
         body = '' AS blank,
         body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
         body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed),
gap(p, q, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'),
         (0, 3, 10, 'II'), (1, 3, 10, 'II'), (2, 2, 10, 'II'), (3, 3, 10, 'II')),
move(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit AS MATERIALIZED (
  SELECT conv_id, n, s.p, s.p AS q, 2 AS cost, 'D' AS letter FROM faults, (VALUES (0), (1), (2), (3)) AS s(p)
  UNION ALL SELECT conv_id, n, m.p, m.q, CASE WHEN truncated THEN 5 ELSE 0 END, 'K' FROM faults f JOIN move m ON m.initial = f.initial WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, n, m.p, m.q, CASE WHEN truncated THEN 6 ELSE 1 END, 'R' FROM faults f, move m WHERE m.initial <> 's' AND NOT blank AND NOT duplicate),
start AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS cell FROM start
  UNION ALL
  SELECT b.conv_id, b.n + 1, e.q, min({'cost': b.cell.cost + g.cost + e.cost, 'audit': b.cell.audit || g.audit || e.letter})
  FROM best b JOIN gap g ON g.p = b.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.n = b.n + 1 AND e.p = g.q
  GROUP BY b.conv_id, b.n, e.q),
counts AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (n > 1 AND before || '>' || initial NOT IN ('s>u', 'u>a', 'a>u')) AS illegal
  FROM faults GROUP BY conv_id),
heads AS MATERIALIZED (
  SELECT s.conv_id, any_value(c.gaps) AS gaps, any_value(c.blank) AS blank, any_value(c.duplicate) AS duplicate,
         any_value(c.truncated) AS truncated, any_value(c.illegal) AS illegal,
         min({'cost': b.cell.cost + g.cost, 'audit': b.cell.audit || g.audit}) AS cell
  FROM start s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id
  JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.n = coalesce(c.rows, 0)
  JOIN gap g ON g.p = b.q AND g.q IN (0, 3)
  GROUP BY s.conv_id),
letters AS (
  SELECT conv_id, i, cell.audit[i] AS letter, length(replace(left(cell.audit, i), 'I', '')) AS n, length(replace(left(cell.audit, i), 'D', '')) AS o
  FROM heads, range(1, length(cell.audit) + 1) AS r(i)),
lines AS (
  SELECT l.conv_id, l.o, l.letter, f.role, f.text, f.initial
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND l.letter <> 'I' WHERE l.letter <> 'D'),
systems AS (SELECT conv_id, o, letter, role, text, max(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM lines),
digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - 1 - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY o)) AS h
  FROM systems GROUP BY conv_id)
SELECT h.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(h.cell.cost AS BIGINT) AS cost, h.cell.audit AS audit, coalesce(d.h, sha256('')) AS repaired_sha256
FROM heads h LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM h.conv_id
"""
