"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is ``host`` followed by ``/path``; it fits a URL whose host is the
rule's or a subdomain of it and whose path starts with the rule's path. All of
it is DataFrame functions.

Every URL offers as candidates its host suffixes with its path prefixes, for
those (labels, path length) shapes that occur in the list. A candidate hashes
to one 64-bit block of the filter and to four bits in it; only candidates
whose bits are all set go on to the exact join with the rules, which removes
false positives. The filter's blocks and the rules are broadcast only up to
``MOST_BLOCKS`` and ``MOST_RULES`` rows, the URLs with rules up to
``MOST_RULES`` rows; beyond, the same joins are shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path and fits no rule; the longest rule wins, of equally long ones that
with the longer host, and of one rule listed twice ``block``; null rules are
ignored; an empty list or table gives unlisted URLs, or no rows; repeated pages
are each judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, materialise

MOST_BLOCKS = 1 << 18
MOST_RULES = 100_000
BITS_PER_RULE = 16

#: The rules of the registered query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (verdict, host, path) as a DataFrame."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LOWER.upper(), LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + F.lit(1)


def _bits(key: Column) -> Column:
    """Four bits of one block."""
    h = F.xxhash64(key, F.lit("bits"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint"))


def url_verdicts(pages: DataFrame, rules: DataFrame, unlisted: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict (the rule's, else ``unlisted``)."""
    listed = (
        rules.select("verdict", ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .where("verdict is not null and rule_host is not null and rule_path is not null")
        .select("verdict", "rule_host", F.concat("rule_host", "rule_path").alias("rule"), labels(F.col("rule_host")).alias("n_labels"), F.length("rule_path").alias("n_path"))
        .groupBy("rule", "rule_host", "n_labels", "n_path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' is the greater word
    )
    n_rules = listed.count()
    shapes = [(r[0], r[1]) for r in listed.select("n_labels", "n_path").distinct().orderBy("n_labels", "n_path").collect()]
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    blocks = max(1, n_rules * BITS_PER_RULE // 64)
    bloom = listed.select(_block(F.col("rule"), blocks).alias("block"), _bits(F.col("rule")).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))
    if blocks <= MOST_BLOCKS:
        bloom = F.broadcast(bloom)
    exact = listed.select("rule", "rule_host", "verdict")
    exact = F.broadcast(exact) if n_rules <= MOST_RULES else exact.hint("shuffle_hash")
    offered = F.explode(F.array(*[F.struct(F.lit(a).alias("n_labels"), F.lit(b).alias("n_path")) for a, b in shapes]))
    suffix = F.expr("substring_index(host, '.', -shape.n_labels)")
    candidates = (
        urls.where("host <> ''")
        .select("host", "path", labels(F.col("host")).alias("n"), F.length("path").alias("m"), offered.alias("shape"))
        .where("n >= shape.n_labels and m >= shape.n_path")
        .select("host", "path", F.concat(suffix, F.expr("substring(path, 1, shape.n_path)")).alias("key"))
    )
    possible = candidates.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block").where(_bits(F.col("key")).bitwiseAND(F.col("word")) == _bits(F.col("key")))
    fits = possible.join(exact, possible["key"] == exact["rule"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "verdict", "rule")).alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best")
    # a table of its own, so that the pages of a hot URL can be split among join tasks; broadcast only up to a checked number of rows
    best = materialise(best, "url-rules")
    best = F.broadcast(best) if best.limit(MOST_RULES + 1).count() <= MOST_RULES else best.hint("merge")
    return urls.join(best, (urls["host"] == best["h"]) & (urls["path"] == best["p"]), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(unlisted)).alias("verdict")
    )


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{LOWER.upper()}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (VALUES {_SQL_RULES}),
fits AS (
  SELECT u.host, u.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
  GROUP BY u.host, u.path
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path
"""
