"""Quality rules with thresholds learnt per language and source from mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, stored

#: Measures of a text, as whole numbers: thousandths of words (hundredths of a character for word length).
MEASURES = {
    "word_length": "word_chars * 100 div n_words",
    "symbols": "n_symbols * 1000 div n_words",
    "dup_lines": "n_dup_lines * 1000 div n_words",
    "repeats": "n_repeat_words * 1000 div n_words",
}


def with_counts(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text (null: no words).

    n_repeat_words counts the words in windows of `window` words that occur twice or more in their text; windows are told
    apart by 64-bit hashes, of one text only. Columns of docs that are called so are replaced.
    """
    blank = "".join(BLANKS)
    t = F.coalesce(F.col(text), F.lit(""))
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = docs.select(*[c for c in docs.columns if c not in new], t.alias("_t"))
    bare = F.btrim("_t", F.lit(blank))
    df = df.withColumn("_w", F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, r"[ \t-\r]+")))
    places = F.when(F.size("_w") > window, F.sequence(F.lit(1), F.size("_w") - window + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    df = df.withColumn("_h", F.transform(places, lambda i: F.xxhash64(F.slice(F.col("_w"), i, window))))
    df = df.withColumn("_repeated", F.size(F.array_distinct("_h")) < F.size("_h"))
    ordered = F.sort_array(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_o", F.when(F.col("_repeated"), ordered))
    alike = F.filter(
        F.col("_o"),
        lambda x, k: (F.get(F.col("_o"), k - 1)["h"] == x["h"]) | (F.get(F.col("_o"), k + 1)["h"] == x["h"]),
    )
    df = df.withColumn("_p", F.sort_array(F.transform(alike, lambda x: x["i"])))
    ahead = F.transform(F.col("_p"), lambda i, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), k + 1) - i, F.lit(window))).cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(blank)) != "")
    return df.withColumn("_l", lines).select(
        *[c for c in docs.columns if c not in new],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", blank, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def bucket_of(x: Column) -> Column:
    """Bucket of a whole number: exact below 64, above it the leading six bits (values of a bucket differ by 1/32 at most)."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (drop * 64 + F.call_function("shiftright", x, drop)).cast("int")


def value_of(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    return F.call_function("shiftleft", (bucket % 64).cast("long"), F.floor(bucket / 64).cast("int"))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each measure's buckets per key: a quantile sketch whose merge is the sum of counts."""
    pairs = ", ".join(f"'{m}', {e}" for m, e in MEASURES.items())
    long = measured.select(*keys, F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, x)"))
    return long.groupBy(*keys, "measure", bucket_of(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and measure: its values' number and quartiles, read off the sketch."""
    rows = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumn("total", F.sum("n").over(rows)).withColumn("upto", F.sum("n").over(rows.orderBy("bucket")))
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, value_of(F.col("bucket")))).alias(f"q{k}") for k in (1, 2, 3)]
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *at)


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = 4, slack: int = 250, enough: int = 200, with_text: bool = False) -> DataFrame:
    """docs (without the text, unless with_text) with counts, base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Every text that passes is judged by
    thresholds of its language and source: each measure may differ from the median by `reach` times the spread of the
    quartiles, and by `slack` at least; where a source has fewer than `enough` passing texts in a language, the thresholds of
    the language hold. Sketches are counts of logarithmic buckets: partial counts add up exactly, whatever the order of rows,
    and a hot source sends no more than its buckets. The thresholds come back by a join on language and source.

    Null or blank texts have no words and fail the base rule. Null languages and sources are groups of their own. Repeated
    rows are judged one by one. An empty table gives no rows. Columns called like the new ones are replaced.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [c for c in docs.columns if c not in (*counts, "base_failed", "kept", text)]
    group = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (lang, source)]
    full = with_counts(docs.select(F.struct(*own).alias("_own"), F.col(text).alias("_text"), group[0].alias("_lang"), group[1].alias("_source")), "_text")
    full = full.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    counted = stored(full.drop("_text"), "quality")
    fine = sketches(counted.filter("not base_failed"), ["_lang", "_source"])
    coarse = fine.groupBy("_lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    wide = quartiles(coarse, ["_lang"]).select("_lang", "measure", *[F.col(f"q{k}").alias(f"w{k}") for k in (1, 2, 3)])
    q = [F.when(F.col("total") >= enough, F.col(f"q{k}")).otherwise(F.col(f"w{k}")) for k in (1, 2, 3)]
    room = F.greatest((q[2] - q[0]) * reach, F.lit(slack))
    sides = quartiles(fine, ["_lang", "_source"]).join(wide, ["_lang", "measure"]).select("_lang", "_source", "measure", (q[1] - room).alias("low"), (q[1] + room).alias("high"))
    limits = sides.groupBy("_lang", "_source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"_{m}_{side}") for m in MEASURES for side in ("low", "high")]
    )
    inside = " and ".join(f"{e} between _{m}_low and _{m}_high" for m, e in MEASURES.items())
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.expr(inside), F.lit(True)))
    shown = ["_own.*"]
    if with_text:  # counted again rather than joined or stored with the texts
        shown, counted = ["_own.*", F.col("_text").alias(text)], full
    return counted.join(limits, ["_lang", "_source"], "left").select(*shown, *counts, "base_failed", kept.alias("kept"))
