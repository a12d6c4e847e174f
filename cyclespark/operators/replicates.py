"""Comparisons across replicate cells, cell health facts, names, and figures about a fit's residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclespark.schema import CELL

UNUSABLE_CYCLES, UNUSABLE_EFFICIENCY = 2, 50.0
DEAD_SHARE, DEAD_RUN = 0.02, 3
FEATURE_GAP_MV = 80.0


def mean_and_spread(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample standard deviation (NULL for one value) and number of the values of each key."""
    x = F.col(value)
    return values.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))


def relative_spread(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(max - min) / |median| of each key's values; NULL for fewer than two or a zero median."""
    agg = values.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.percentile(value, 0.5).alias("median")
    )
    spread = F.when((F.col("n") >= 2) & (F.col("median") != 0), (F.col("hi") - F.col("lo")) / F.abs("median"))
    return agg.select(*keys, "n", spread.alias("spread"))


def unusable_cells(facts: DataFrame) -> DataFrame:
    """Why a cell's data (``n_cycles``, ``median_ce``) can't vote among replicates; ``unusable`` if for any reason."""
    few = F.coalesce(F.col("n_cycles") <= UNUSABLE_CYCLES, F.lit(False))
    low = F.coalesce(F.col("median_ce") < UNUSABLE_EFFICIENCY, F.lit(False))
    return facts.select(*CELL, few.alias("few_cycles"), low.alias("low_efficiency"), (few | low).alias("unusable"))


def death_cycles(table: DataFrame) -> DataFrame:
    """Last live cycle of each cell, and the death cycle if three or more dead ones follow it.

    A cycle is live while its discharge capacity is above 2 % of the 90th
    percentile of the cell's complete cycles.
    """
    complete = F.when(~F.col("incomplete") & ~F.col("partial_final"), F.col("discharge_mAh_g"))
    floor = table.groupBy(*CELL).agg((F.percentile(complete, 0.9) * DEAD_SHARE).alias("floor"))
    rows = table.join(floor, CELL)
    live = complete > F.col("floor")
    last = rows.groupBy(*CELL).agg(F.max("floor").alias("floor"), F.max(F.when(live, F.col("cycle"))).alias("last_live"))
    dead = F.col("discharge_mAh_g").isNull() | (F.col("discharge_mAh_g") <= F.col("floor"))
    tail = rows.drop("floor").join(last, CELL).filter((F.col("cycle") > F.col("last_live")) & dead)
    counted = tail.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_dead"))
    return last.join(counted, CELL, "left").select(
        *CELL, "last_live", F.coalesce("n_dead", F.lit(0)).alias("n_dead"), F.when(F.col("n_dead") >= DEAD_RUN, F.col("last_live")).alias("death_cycle")
    )


def feature_groups(points: DataFrame, keys: list[str], gap_mv: float = FEATURE_GAP_MV) -> DataFrame:
    """Drifts of tracked peaks grouped into features: sorted by voltage and split at gaps above ``gap_mv``.

    ``points``: keys, cell_id, voltage, drift.  A cell counts once in a feature, with its median drift.
    """
    w = Window.partitionBy(*keys).orderBy("voltage")
    new = F.coalesce((F.col("voltage") - F.lag("voltage").over(w)) * 1000.0 > gap_mv, F.lit(True))
    rows = points.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("feature", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    per_cell = rows.groupBy(*keys, "feature", *CELL).agg(F.percentile("drift", 0.5).alias("_d"), F.sum("voltage").alias("_v"), F.count(F.lit(1)).alias("_k"))
    return per_cell.groupBy(*keys, "feature").agg(
        (F.sum("_v") / F.sum("_k")).alias("voltage"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"), F.count("_d").alias("n"), F.sum("_k").alias("n_peaks")
    )


def coherent_net_change(series: DataFrame, keys: list[str], gap: int = 3, edge: int = 3, least: int = 5) -> DataFrame:
    """Change of ``value`` over ``cycle`` up to the first gap of ``gap`` missing cycles: median of the last less that of the first ``edge``."""
    w = Window.partitionBy(*keys).orderBy("cycle")
    rows = series.select(*keys, F.col("cycle").cast("double").alias("cycle"), "value").na.drop()
    rows = rows.withColumn("_gap", (F.col("cycle") - F.lag("cycle").over(w) - 1 >= gap).cast("int"))
    lead = rows.withColumn("_gaps", F.sum(F.coalesce("_gap", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_gaps = 0")
    whole = Window.partitionBy(*keys)
    ranked = lead.select("*", F.row_number().over(w).alias("_r"), F.count(F.lit(1)).over(whole).alias("_n"), F.count(F.lit(1)).over(whole).alias("n_used"))
    size = F.greatest(F.lit(1), F.least(F.lit(edge), F.floor(F.col("_n") / 2)))
    agg = ranked.groupBy(*keys).agg(
        F.max("n_used").alias("n_used"),
        F.percentile(F.when(F.col("_r") <= size, F.col("value")), 0.5).alias("v_start"),
        F.percentile(F.when(F.col("_r") > F.col("_n") - size, F.col("value")), 0.5).alias("v_end"),
        F.min("cycle").alias("c_start"), F.max("cycle").alias("c_end"),
    )
    enough = F.col("n_used") >= least
    return agg.select(
        *keys, F.when(enough, F.col("v_end") - F.col("v_start")).alias("net_change"), F.when(enough, F.col("v_start")).alias("v_start"),
        F.when(enough, F.col("v_end")).alias("v_end"), "c_start", "c_end", "n_used",
    )


def common_cycles(left: DataFrame, right: DataFrame, keys: list[str], first: Column | int = 2) -> DataFrame:
    """Cycles that both series of a pair have, from ``first`` on."""
    first = F.lit(first) if isinstance(first, int) else first
    return left.select(*keys, "cycle").distinct().join(right.select(*keys, "cycle").distinct(), [*keys, "cycle"]).filter(F.col("cycle") >= first)


def runs_test(residuals: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """z of the number of same-sign runs of the residual; NULL under ten signs or with one sign only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    signs = residuals.select(*keys, *order, F.signum(value).alias("_s")).filter("_s <> 0")
    turns = signs.withColumn("_t", F.coalesce((F.col("_s") != F.lag("_s").over(w)).cast("int"), F.lit(0)))
    agg = turns.groupBy(*keys).agg(
        F.sum((F.col("_s") > 0).cast("double")).alias("a"), F.sum((F.col("_s") < 0).cast("double")).alias("b"), (F.sum("_t") + 1).alias("runs")
    )
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    twice = 2.0 * a * b
    var = twice * (twice - n) / (n * n * (n - 1))
    z = F.when((n >= 10) & (a > 0) & (b > 0) & (var > 0), (F.col("runs") - (twice / n + 1.0)) / F.sqrt(var))
    return agg.select(*keys, z.alias("residual_runs_z"))


def fit_quality(points: DataFrame, keys: list[str]) -> DataFrame:
    """Height ratio, overshoot, largest residual and runs z of a fit: points with voltage, dqdv, total and baseline."""
    y, t, b = F.col("dqdv"), F.col("total"), F.col("baseline")
    agg = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(y).alias("y1"), F.min(y).alias("y0"), F.max(t).alias("t1"), F.min(t).alias("t0"),
        F.max(F.abs(y - b)).alias("high"), F.max(F.abs(t - b)).alias("fitted"), F.max(F.abs(y - t)).alias("off"),
    )
    amp = F.col("y1") - F.col("y0")
    enough = F.col("n") >= 3
    over = F.greatest(F.col("t1") - F.col("y1"), F.col("y0") - F.col("t0"), F.lit(0.0))
    runs = runs_test(points.withColumn("_off", y - t), keys, ["voltage"], "_off")
    return agg.join(runs, keys, "left").select(
        *keys, F.when(enough & (F.col("high") > 0), F.col("fitted") / F.col("high")).alias("height_ratio"),
        F.when(enough & (amp > 0), over / amp).alias("overshoot"), F.when(enough & (amp > 0), F.col("off") / amp).alias("max_residual_frac"),
        F.when(enough, F.col("residual_runs_z")).alias("residual_runs_z"),
    )


def _varying_number(names: DataFrame, group: list[str]) -> DataFrame:
    """(group, name, token): the first number of a name, by place, that isn't the same in all names of its group."""
    digits = names.select(*group, "name", F.regexp_extract_all("name", F.lit(r"\d+"), F.lit(0)).alias("t"))
    shortest = digits.groupBy(*group).agg(F.min(F.size("t")).alias("shortest"))
    places = digits.select(*group, F.posexplode("t").alias("at", "token")).groupBy(*group, "at").agg(F.count_distinct("token").alias("k"))
    first = places.join(shortest, group).filter("k > 1 AND at < shortest").groupBy(*group).agg(F.min("at").alias("at"))
    return digits.join(first, group, "left").select(*group, "name", F.get("t", F.col("at")).alias("token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


def suggest_cell_ids(names: DataFrame, group: list[str]) -> DataFrame:
    """Cell identifier in each file name: "cell X", else the last letter between delimiters, else the number that varies; else ''."""
    stated = F.regexp_extract("name", r"[Cc]ell[\s_-]?([A-Za-z0-9])(?![A-Za-z0-9])", 1)
    # Matches don't overlap: a delimiter that ends one match can't begin the next.
    letters = F.regexp_extract_all("name", F.lit(r"[_-]([A-Za-z])[_-]"), F.lit(1))
    found = names.join(_varying_number(names, group), [*group, "name"])
    letter = F.try_element_at(letters, F.lit(-1))
    return found.select(
        *group, "name", F.coalesce(F.when(stated != "", F.upper(stated)), F.upper(letter), F.col("token"), F.lit("")).alias("cell_guess")
    )


def display_names(names: DataFrame, group: list[str]) -> DataFrame:
    """Composition, with the cell added where a group holds it more than once.

    ``names``: group, name, composition, stated_id (or NULL).  The cell is the
    stated one, else the first letter between underscores, else the number that
    varies, else the last number, else the place in the group.
    """
    same = [*group, "composition"]
    side = Window.partitionBy(*same)
    rows = names.join(_varying_number(names, same), [*same, "name"]).withColumn("_k", F.count(F.lit(1)).over(side))
    rows = rows.withColumn("_i", F.row_number().over(side.orderBy("name")).cast("string"))
    letter = F.regexp_extract("name", "_([A-Za-z])_", 1)
    stated = F.trim("stated_id")
    cell = F.coalesce(F.when(stated != "", stated), F.when(letter != "", F.upper(letter)), F.col("token"), F.col("last_token"), F.col("_i"))
    shown = F.when(F.col("_k") > 1, F.concat("composition", F.lit(" (Cell "), cell, F.lit(")"))).otherwise(F.col("composition"))
    return rows.select(*group, "name", shown.alias("display_name"))
