"""Document fingerprints from closed syncmers over words."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))


def with_anchors(df: DataFrame, text: str, name: str, k: int = 4, s: int = 2) -> DataFrame:
    """df with `name`: array of (place, hash) of the closed syncmers of each text, places in words from 1.

    A run of k words is a closed syncmer if the smallest hash among its runs of s words is that of the first or the last; which
    runs are chosen depends on nothing around them. A text of 1 to k - 1 words has itself as its only anchor; null, empty and
    blank texts have none.
    """
    blank = "".join(BLANKS)
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(blank))
    df = df.withColumn("_w", F.when(bare == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.split(bare, r"[ \t-\r]+"), lambda w: F.xxhash64(w))))
    df = df.withColumn("_s", F.transform(_places(F.size("_w") - s + 1), lambda i: F.xxhash64(F.slice(F.col("_w"), i, s))))
    span = k - s + 1

    def chosen(i: Column) -> Column:
        return F.array_min(F.slice(F.col("_s"), i, span)) == F.least(F.get(F.col("_s"), i - 1), F.get(F.col("_s"), i + (span - 2)))

    picked = F.transform(F.filter(_places(F.size("_w") - k + 1), chosen), lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(F.col("_w"), i, k)).alias("hash")))
    short = F.array(F.struct(F.lit(1).alias("place"), F.xxhash64("_w").alias("hash")))
    return df.withColumn(name, F.when(F.size("_w").between(1, k - 1), short).otherwise(picked)).drop("_w", "_s")


def sketch(anchors: Column, keep: int) -> Column:
    """The `keep` smallest distinct anchor hashes: a bounded fingerprint of the whole text."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors, lambda a: a["hash"]))), 1, keep)


def likeness(a: Column, b: Column, keep: int) -> Column:
    """Share of common anchors among the `keep` smallest of both (exact where both have fewer); 1 for two empty ones."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, keep)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def _range_of(key: str, cuts: list, parts: list[int], null_parts: int) -> Column:
    """A row's range by key and `_tie`, larger for rows that come earlier: 2 i + 1 for the cut i itself, even numbers between cuts.

    Ranges of a cut and of null keys (-1) are cut again into so many parts of equal width of `_tie`.
    """
    names = ",".join(map(repr, cuts))
    kept = F.split(F.lit(names), ",").cast("array<double>") if cuts else F.expr("cast(array() as array<double>)")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))])
    x = F.col(key).cast("double")

    def below(inside) -> Column:  # how many cuts lie before x, by halving
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(inside(F.get(kept, at + step - 1)), F.lit(False)), step).otherwise(0))

    place = F.when(x.isNull(), -1).otherwise(below(lambda c: c < x) + below(lambda c: c <= x))
    counts = F.split(F.lit(",".join(map(str, parts))), ",").cast("array<int>") if cuts else F.expr("cast(array() as array<int>)")
    n_parts = F.when(x.isNull(), null_parts).when(place % 2 == 1, F.get(counts, F.floor(place / 2).cast("int"))).otherwise(1)
    part = F.least(F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * n_parts), n_parts - 1)
    return place.cast("long") * 2**20 - part


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", prepare=lambda df: df, ranges: int = 16384) -> DataFrame:
    """prepare(docs) with next_<column> of the document that follows by descending key; the first follows the last.

    Keys are cut into up to `ranges` ranges by their quantiles, each sorted on its own; the first row of a range also stands at
    the end of the range before it. A key that is a cut is a range of its own; keys with many rows, and null keys, are cut by
    the hash that orders their rows, so that neither far-off keys nor repeated ones gather rows. The ranges' first keys (one for
    each range) are ordered in one task and sent to all. Null keys come last; rows with the same key follow each other in order
    of a hash of all their columns.
    """
    n, nulls, cuts = docs.agg(F.count("*"), F.count_if(F.col(key).isNull()), F.percentile_approx(key, [i * 2 / ranges for i in range(1, ranges // 2)], 50_000)).first()
    often = Counter(cuts or [])
    places, parts = sorted(often), [often[x] for x in sorted(often)]
    rows = docs.withColumn("_tie", F.xxhash64(*docs.columns)).withColumn("_range", _range_of(key, places, parts, 1 + nulls * ranges // (2 * n) if n else 1))
    tops = rows.groupBy("_range").agg(F.max(F.struct(F.col(key).alias("k"), F.bitwise_not("_tie").alias("t"))).alias("_top"))
    by_range = Window.orderBy(F.col("_range").desc())
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_range").over(by_range), F.last("_range").over(everything))
    tops = F.broadcast(tops.select(F.col("_range").alias("_r"), F.col("_top.k").alias("_top"), F.bitwise_not("_top.t").alias("_first"), before.alias("_to")))  # about `ranges` rows at most
    firsts = rows.join(tops, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_top")) & (F.col("_tie") == F.col("_first")))
    others = [c for c in docs.columns if c != key]
    firsts = firsts.groupBy("_to").agg(F.min(F.struct("_tie", *[F.col(c).alias(f"_{c}") for c in others])).alias("_f"))
    ends = firsts.select(F.col("_to").alias("_range"), *[F.col(f"_f._{c}").alias(c) for c in others]).withColumn("_end", F.lit(True))
    both = prepare(rows).withColumn("_end", F.lit(False)).unionByName(prepare(ends), allowMissingColumns=True)
    within = Window.partitionBy("_range").orderBy("_end", F.col(key).desc_nulls_last(), "_tie")
    return both.select("*", *[F.lead(c).over(within).alias(f"next_{c}") for c in columns]).filter("not _end").drop("_end", "_range", "_tie")


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: int = 64, k: int = 4, s: int = 2) -> DataFrame:
    """docs (without the text) with fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document by descending
    key. A fingerprint is the `keep` smallest syncmer hashes of the whole text. near_edited compares it with the edited text's,
    near_next with the next document's. Null texts count as empty; two empty fingerprints are alike (1), an empty and another
    are not (0). A single document follows itself. Repeated rows and keys are defined by with_next. Columns called like the
    new ones are replaced.
    """
    new = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    own = [c for c in docs.columns if c not in new and c != text]
    df = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = with_next(df, ["_text", "_fp"], key, lambda x: with_anchors(x, "_text", "_a", k, s).withColumn("_fp", sketch(F.col("_a"), keep)).drop("_a"))
    df = df.withColumn("_n", F.length("_text")).withColumn("_half", F.floor(F.col("_n") / 2).cast("int"))
    df = df.withColumn("_edited", F.concat(F.expr("substring(_text, 1, _n - _half)"), F.expr("substring(next__text, 1, _half)")))
    df = with_anchors(df, "_edited", "_a", k, s).withColumn("_efp", sketch(F.col("_a"), keep))
    return df.select(
        *own,
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.concat_ws(",", F.col("_fp").cast("array<string>")).alias("fingerprint"),
        F.concat_ws(",", F.col("_efp").cast("array<string>")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp"), keep).alias("near_edited"),
        likeness(F.col("_fp"), F.col("next__fp"), keep).alias("near_next"),
    )
