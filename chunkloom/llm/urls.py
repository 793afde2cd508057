"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (host, path, verdict) fits its host, all subdomains, and paths that start with its path. With the host's
labels reversed, "host and subdomains" is an interval of keys below the rule's path prefix. Rule starts, rule ends
and sites are sorted together, and a sweep carries the top of the stack of open rules: a start pushes its rule, an
end pops to the rule's parent, found beforehand. Sites are distinct (host, path prefix) pairs, so a hot host or page
costs one row of the sweep. The sweep is dealt into key ranges; a range begins with the rules open at its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges of the sweep at least (else one a shuffle partition), and sites read to place their bounds; both only balance the work.
RANGES, SAMPLE = 64, 4096
#: Lengths of rule paths up to which only those are cut out of a site's path; with more, all its prefixes are.
LENGTHS = 1024
RULES = "rule_key string, rule string, verdict string, host_key string, path_key string, size int"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def spelled(text: Column) -> Column:
    """Without U+0000 to U+0003, which the keys use as marks; these become two characters each."""
    for c in "3012":
        text = F.replace(text, F.lit(chr(int(c))), F.lit("\u0003" + c))
    return text


def reversed_host(host: Column) -> Column:
    """``a.b.com`` as ``com\\u0001b\\u0001a\\u0001``: a label's end sorts below any character of a longer label."""
    return F.concat(F.array_join(F.reverse(F.split(spelled(host), r"\.")), "\u0001"), F.lit("\u0001"))


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules by path prefix and reversed host; of rules with the same host and path the blocking one holds."""
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        rules.filter("host is not null and path is not null and verdict is not null")
        .groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("path_key"), reversed_host(F.col("host")).alias("host_key"), F.length("path").alias("path_size"))
        .withColumn("size", F.length("rule"))
    )


def _with_parents(rules: DataFrame) -> DataFrame:
    """Adds the nearest enclosing rule of the same path prefix: an equi-join on every shorter run of labels."""
    labels = F.split(F.expr("substring(host_key, 1, length(host_key) - 1)"), "\u0001")
    up = rules.select("path_key", "host_key", F.explode(F.expr("sequence(1, greatest(1, length(host_key) - length(replace(host_key, '\u0001', '')) - 1))")).alias("n"), labels.alias("labels"))
    up = up.filter("n < size(labels)").select("path_key", "host_key", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "\u0001"), F.lit("\u0001")).alias("up_key"))
    of = rules.select("path_key", F.col("host_key").alias("up_key"), F.struct(F.length("host_key").alias("depth"), "rule", "verdict", "size").alias("parent"))
    parents = up.join(of, ["path_key", "up_key"]).groupBy("path_key", "host_key").agg(F.max("parent").alias("parent"))
    return rules.join(parents, ["path_key", "host_key"], "left")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """Host, path, longest fitting rule and verdict of every row: ``key``, host, path, rule, verdict.

    ``rules`` has host, path (a plain prefix, with its slash) and verdict (allow or block). The longest rule is the
    one whose host and path together have most characters. A null url, or one without ``://``, has an empty host
    and path and so fits no rule; rows without a rule get ``otherwise``. Repeated rows and null keys give a row each.
    """
    spark = pages.sparkSession
    rules = _with_parents(_keyed(rules))
    sizes = sorted(r[0] for r in rules.select("path_size").distinct().limit(LENGTHS + 1).collect())
    longest = rules.agg(F.max("path_size")).first()[0] or 0
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select(pages[key].alias("row_key"), host_of(pages[url].cast("string")).alias("host"), path_of(pages[url].cast("string")).alias("path"))
    sites = rows.select("host", F.substring("path", 1, longest).alias("head")).filter("host <> ''").distinct()
    # one key for each length of rule path that the site's path can hold
    lengths = F.sequence(F.lit(0), F.lit(longest)) if len(sizes) > LENGTHS else F.array(*map(F.lit, sizes)).cast("array<int>")
    keyed = sites.select("host", "head", F.explode(F.filter(lengths, lambda n: n <= F.length("head"))).alias("n"))
    keyed = keyed.select("host", "head", F.expr("substring(head, 1, n)").alias("path_key"), reversed_host(F.col("host")).alias("host_key"))
    keyed = keyed.join(rules.select("path_key").distinct(), "path_key", "left_semi")

    # bounds of the key ranges, from a bounded number of sites
    sep = F.lit("\u0000")
    place = F.concat(spelled(F.col("path_key")), sep, "host_key")
    seen = sorted(r[0] for r in keyed.select(place.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLE).collect())
    bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("k"))) if bounds else F.lit(0)

    top = lambda p: F.struct(*[F.col(f"{p}rule").alias("rule"), F.col(f"{p}verdict").alias("verdict"), F.col(f"{p}size").alias("size")])
    start, end = place, F.concat(spelled(F.col("path_key")), sep, F.expr("concat(substring(host_key, 1, length(host_key) - 1), '\u0002')"))
    spans = rules.select(start.alias("k"), end.alias("k_end"), F.length("host_key").alias("depth"), top("").alias("own"), F.when(F.col("parent").isNotNull(), top("parent.")).alias("parent"))
    spans = spans.withColumn("first", number).withColumn("last", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("k_end"))) if bounds else F.lit(0))
    # kind: ends (0) come before starts (1) and sites (2) of the same key; a shallow rule opens first and closes last
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("size"))
    opened = spans.select(F.explode(F.sequence("first", "last")).alias("part"), F.when(F.col("part") > F.col("first"), F.lit("")).otherwise(F.col("k")).alias("k"), F.lit(1).alias("kind"), F.col("depth"), F.col("own").alias("top"))
    closed = spans.select(F.col("last").alias("part"), F.col("k_end").alias("k"), F.lit(0).alias("kind"), (-F.col("depth")).alias("depth"), F.coalesce("parent", none).alias("top"))
    asked = keyed.withColumn("k", place).select(number.alias("part"), "k", F.lit(2).alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(opened.schema["top"].dataType).alias("top"), "host", "head")
    blank = [F.lit(None).cast("string").alias(c) for c in ("host", "head")]
    events = opened.select("*", *blank).unionByName(closed.select("*", *blank)).unionByName(asked)
    order = Window.partitionBy("part").orderBy("k", "kind", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("top", ignorenulls=True).over(order)).filter("kind = 2 and open.rule is not null")
    found = swept.groupBy("host", "head").agg(F.max_by("open", F.struct("open.size", "open.rule")).alias("best"))

    found = found.select(F.col("host").alias("site_host"), F.col("head").alias("site_head"), "best")
    joined = rows.join(found, (F.col("host") == F.col("site_host")) & (F.substring("path", 1, longest) == F.col("site_head")), "left")
    return joined.select(F.col("row_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A literal table of (host, path, verdict), without Python rows in the plan."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(text, r))})" for r in rules) + " as t(host, path, verdict)")


def sql(rules: list[tuple[str, str, str]], otherwise: str = "allow") -> str:
    """DuckDB SQL of ``judge`` over ``pages``."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
    u AS (SELECT page_id, row_number() OVER () AS n,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    f AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                 arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
          FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
    SELECT page_id, host, path, f.rule, coalesce(f.verdict, '{otherwise}') AS verdict FROM u LEFT JOIN f USING (n)"""
