"""URL filters: host-suffix and path-prefix rules found by hash-prefix joins.

Method: a URL is expanded into expressions, every host suffix (at label
borders) joined to every path prefix that a rule could have.  Rules and
expressions meet in an equi-join on the first 32 bits of their SHA-256; the
full digests are then compared and the most specific rule decides.  Only
suffixes with a rule's number of labels and prefixes of a rule path's length
are expanded, which loses nothing and keeps long hosts and paths cheap.

Distinct (host, path) pairs are judged once, so a host or URL that a third of
the pages share costs one row per map task.  DataFrame functions only.

Precedence: the rule with the longest host + path wins; at equal length the
longer host, then block over allow, then the smaller rule text.

Defined cases: a null URL, or one without ``://``, has empty host and path and
matches no rule; no matching rule gives rule null and the default verdict;
rules that are null or have an empty host match nothing; repeated pages are
judged row by row; an empty page or rule table works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import small

DEFAULT_VERDICT = "allow"
SHORT_HEX = 8  # 32 bits of the digest
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url):
    """Lower-cased host after the first ``://`` and the path up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.regexp_extract(url, URL_PARTS, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule, verdict)`` pairs as a table; a rule is host + path prefix, like ``example.com/en/``."""
    quoted = ", ".join("({}, {})".format(*("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in pair)) for pair in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS r(rule, verdict)")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Every page's ``page_id, host, path, rule, verdict``."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    lowered = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    known = (
        rules.where("rule is not null and verdict is not null")
        .select("rule", "verdict", lowered.alias("rule_host"))
        .withColumn("rule_path", F.expr("substring(rule, length(rule_host) + 1)"))
        .where("rule_host <> ''")
        .withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
        .withColumn("short", F.substring("digest", 1, SHORT_HEX))
        .distinct()
    )
    # two short lists: the label counts and path lengths that rules have
    shape = known.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    labels = F.array(*[F.lit(x) for x in sorted(shape.labels)]) if shape.labels else F.array().cast("array<int>")
    lengths = F.array(*[F.lit(x) for x in sorted(shape.lengths)]) if shape.lengths else F.array().cast("array<int>")
    urls = parsed.where("host <> ''").select("host", "path").distinct()
    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.filter(labels, lambda m: m <= n_labels), lambda m: F.call_function("substring_index", F.col("host"), F.lit("."), -m))
    prefixes = F.transform(F.filter(lengths, lambda m: m <= F.length("path")), lambda m: F.col("path").substr(F.lit(1), m))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = (
        urls.select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, SHORT_HEX))
        .drop("expression")
    )
    side = known.select("short", "digest", "rule", "verdict", "rule_host")
    side = F.broadcast(side) if small(side, BROADCAST_RULES) else side.hint("merge")
    order = F.struct(
        F.length("rule").alias("n"),
        F.length("rule_host").alias("h"),
        (F.col("verdict") == "block").cast("int").alias("b"),
    )
    matched = asked.join(side, "short").where(F.col("full") == F.col("digest"))
    # max of the order; among equal orders the smaller rule text
    best = matched.groupBy("host", "path", order.alias("o")).agg(F.min(F.struct("rule", "verdict")).alias("r"))
    best = best.groupBy("host", "path").agg(F.max(F.struct("o", "r")).alias("best"))
    found = best.select("host", "path", F.col("best.r.rule").alias("rule"), F.col("best.r.verdict").alias("verdict"))
    return parsed.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


#: The contract's rules (fixed values).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

RULES_SQL = r"""
WITH rules(rule, verdict) AS (VALUES
  ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(r.rule, length(r.rule)) FROM rules r
    WHERE (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
      AND starts_with(p.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.rule)) FROM rules r
    WHERE (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
      AND starts_with(p.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))), 'allow') AS verdict
FROM parsed p
"""
