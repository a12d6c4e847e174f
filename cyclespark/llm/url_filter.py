"""URL filter by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where :// is missing."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_bits: int = 32) -> DataFrame:
    """pages with host, path, rule and verdict for each row.

    rules: host, path, action ('allow' or 'block'). A rule fits its host and all subdomains where the url's path starts with
    the rule's path; the longest rule (host and path together) wins, of two alike 'block'. Urls that no rule fits get a null
    rule and `default`.

    Each distinct url is expanded into every suffix of its host that ends at a dot, times every prefix of its path of a
    length that some rule has. Expressions meet the rules on the first `prefix_bits` of their SHA-256; the full digest
    confirms. Lengths of rule paths are the only thing that comes to the driver: at most as many as the longest path has
    characters. Repeated urls are judged once; a rule table of any size is joined, and broadcast only if Spark finds it small.

    Null url: host and path empty, default verdict. Empty tables give no rows or all defaults. Rules with a null host, path or
    action are void; repeated rules count once. Columns of pages that are called like the new ones are replaced.
    """
    spare = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    known = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), F.col("path").alias("p"), F.col("action").alias("action"))
        .na.drop()
        .filter(F.col("action").isin("allow", "block"))
        .distinct()
        .withColumn("digest", F.sha2(F.concat_ws("\x00", "h", "p"), 256))
        .withColumn("head", F.expr(f"substring(digest, 1, {prefix_bits // 4})"))
    )
    lengths = [r[0] for r in known.select(F.length("p")).distinct().collect()]
    urls = pages.select(F.col(url).alias("_url")).filter(F.col("_url").isNotNull()).distinct()
    host, path = host_and_path(F.col("_url"))
    urls = urls.select("_url", host.alias("_host"), path.alias("_path"))
    hosts = F.expr("transform(sequence(1, size(split(_host, '[.]'))), i -> substring_index(_host, '.', -i))")
    cuts = F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.expr("cast(array() as array<int>)")
    told = (
        urls.withColumn("_cut", F.explode(F.filter(cuts, lambda n: n <= F.length("_path"))))
        .select("_url", F.explode(hosts).alias("_suffix"), F.expr("substring(_path, 1, _cut)").alias("_prefix"))
        .withColumn("_digest", F.sha2(F.concat_ws("\x00", "_suffix", "_prefix"), 256))
        .withColumn("head", F.expr(f"substring(_digest, 1, {prefix_bits // 4})"))
        .join(known, "head")
        .filter(F.col("_digest") == F.col("digest"))
        .groupBy("_url")
        .agg(F.max(F.struct(F.length("h") + F.length("p"), F.length("p"), F.col("action"), F.concat("h", "p").alias("rule"))).alias("_won"))
        .select(F.col("_url").alias("_told"), F.col("_won.rule").alias("rule"), F.col("_won.action").alias("_action"))
    )
    host, path = host_and_path(F.col(url))
    return pages.select(*spare, host.alias("host"), path.alias("path")).join(told, F.col(url) == F.col("_told"), "left").select(
        *spare, "host", "path", "rule", F.coalesce("_action", F.lit(default)).alias("verdict")
    )
