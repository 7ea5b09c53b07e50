"""URL filters by a sort-merge range join, in DataFrame functions only.

A host's labels are reversed and each is closed by U+0001, so that a rule's
host and its subdomains are one interval of keys, from its key up to the key
with the last U+0001 replaced by U+0002.  Rule intervals are nested or apart.
Each boundary carries the stack of rules that are active from there on: at a
start the rule and those around it, at an end those around it.  Urls and
boundaries are sorted together by key, and a forward sweep (last stack seen)
gives every url its active rules; the path prefix then picks the longest.

Distribution: urls are dealt to buckets by a hash of the whole row, so neither
a hot host nor a hot domain gathers in a task; the boundaries (two for each rule
host) are copied to every bucket.  One shuffle, of id, host and path only.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no rule; repeated rows give a row each; an empty table gives an empty
table; other columns are ignored, whatever their names; without a rule that
fits, rule is null and the verdict is the default.  The longest rule is that of
the longest host-and-path string; of equal ones the longer host, then a block.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict (fixed values)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, verdict) as a table."""
    rows = F.array(*(F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def _key(host):
    """Canonical key: reversed labels, each closed by U+0001."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "\u0001"), F.lit("\u0001"))


def with_parts(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path) of each row."""
    cut = pages.select(pages[page_id].alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("u"))
    cut = cut.select("page_id", F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("").alias("rest"))
    return cut.select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): starts (kind 1) and ends (kind 0) of the rule hosts' intervals with the rules active from there."""
    rules = rules.select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "verdict")
    entry = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path", "verdict",
    )
    own = rules.groupBy(_key(F.col("rule_host")).alias("key")).agg(F.collect_set(entry).alias("rules"))
    # every prefix of whole labels that is a rule host too encloses this one
    up = own.select("key", F.explode(F.expr("transform(sequence(1, size(split(key, '\\u0001')) - 1), i -> concat(array_join(slice(split(key, '\\u0001'), 1, i), '\\u0001'), '\\u0001'))")).alias("outer_key"))
    around = up.join(own.select(F.col("key").alias("outer_key"), "rules"), "outer_key").groupBy("key").agg(
        F.flatten(F.collect_list("rules")).alias("all"), F.flatten(F.collect_list(F.when(F.col("outer_key") != F.col("key"), F.col("rules")))).alias("outer")
    )
    starts = around.select("key", F.lit(1).alias("kind"), F.col("all").alias("stack"))
    ends = around.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("\u0002")).alias("key"), F.lit(0).alias("kind"), F.col("outer").alias("stack"))
    return starts.unionByName(ends)


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    buckets = partitions(pages.sparkSession)
    events = boundaries(rules).select("key", "kind", "stack", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    urls = with_parts(pages, page_id, url)
    urls = urls.select("*", _key(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(buckets)).cast("int").alias("bucket"))
    both = urls.unionByName(events.withColumn("bucket", F.col("bucket").cast("int")), allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    fits = F.expr("filter(active, r -> startswith(path, r.rule_path) and (host = r.rule_host or endswith(host, concat('.', r.rule_host))))")
    best = active.select("page_id", "host", "path", F.array_max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""
