"""Scalar column functions: parsing, rates, chemistry, peak shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conventional C-rates (fixed values): C/100 .. 20C.
CONVENTIONAL_RATES = (1 / 100, 1 / 50, 1 / 20, 1 / 10, 1 / 5, 1 / 4, 1 / 3, 1 / 2, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0)
RATE_SNAP = 0.10

FARADAY_MAH_PER_MOL = 96485.33212 / 3.6

# Specific-capacity library (fixed values): formula, electrons, molar mass, ion, aliases.
CAPACITY_LIBRARY = (
    ("LiCoO2", 1.0, 97.871, "Li", ("lco", "licoo2", "lithiumcobaltoxide", "lithiumcobaltate")),
    ("LiMn2O4", 1.0, 180.812, "Li", ("lmo", "limn2o4", "lithiummanganeseoxide", "lithiummanganatespinel")),
    (
        "LiNi1/3Mn1/3Co1/3O2", 1.0, 96.460, "Li",
        ("nmc111", "ncm111", "mnc111", "lini13mn13co13o2", "lini033mn033co033o2", "lini0333mn0333co0333o2"),
    ),
    ("LiNi0.8Mn0.1Co0.1O2", 1.0, 97.280, "Li", ("nmc811", "ncm811", "mnc811", "lini08mn01co01o2")),
    ("LiCoMnO4", 1.0, 184.807, "Li", ("licomno4", "lcmo", "limncoo4")),
    ("Li4Ti5O12", 3.0, 459.083, "Li", ("lto", "li4ti5o12", "lithiumtitanate", "lithiumtitaniumoxide")),
    ("Na0.67Ni0.33Mn0.67O2", 0.67, 103.578, "Na", ("nnm", "na067ni033mn067o2")),
)

# Counter-electrode defaults (fixed values): g/cm3, mm, mm.
METAL_DENSITY = {"Li": 0.534, "Na": 0.971}
COUNTER_THICKNESS_MM = 0.5
COUNTER_DIAMETER_MM = 16.0


def leading_number(text: Column) -> Column:
    """Number at the start of text such as "12.72mg"; NULL when there is none."""
    return F.regexp_extract(F.trim(text), r"^([+-]?\d*\.?\d+)", 1).try_cast("double")


def duration_seconds(text: Column) -> Column:
    """Seconds in "H:M:S", "M:S", "S" or "D-H:M:S" text."""
    t = F.trim(text)
    has_days = t.contains("-")
    days = F.when(has_days, F.split_part(t, F.lit("-"), F.lit(1)).try_cast("int")).otherwise(F.lit(0))
    clock = F.when(has_days, F.regexp_replace(t, "^[^-]*-", "")).otherwise(t)
    parts = F.reverse(F.split(clock, ":"))

    def unit(i: int) -> Column:
        value = F.try_element_at(parts, F.lit(i)).try_cast("double")
        return value if i == 1 else F.when(F.size(parts) >= i, value).otherwise(F.lit(0.0))

    return days * 86400.0 + unit(3) * 3600.0 + unit(2) * 60.0 + unit(1)


def step_sign(step: Column) -> Column:
    """+1 for charge, -1 for anything else."""
    return F.when(F.lower(step).startswith("charge"), 1).otherwise(-1)


def composition_key(text: Column) -> Column:
    """Lower-case composition without separators."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\-_,.()\[\]/·]", ""))


def capacity_library(spark) -> DataFrame:
    """Lookup dimension: one row per accepted name."""
    rows = []
    for formula, n, mass, ion, aliases in CAPACITY_LIBRARY:
        plain = "".join(ch for ch in formula if ch not in " -_,.()[]/·").lower()
        for name in sorted({plain, *aliases}):
            rows.append((name, formula, round(n * FARADAY_MAH_PER_MOL / mass, 1), ion))
    return spark.createDataFrame(rows, "key string, formula string, library_mAh_g double, library_ion string")


def with_library_capacity(cells: DataFrame, composition: str = "composition") -> DataFrame:
    """Add the library's theoretical capacity and ion for an exact name match."""
    library = capacity_library(cells.sparkSession)
    return cells.withColumn("key", composition_key(F.col(composition))).join(F.broadcast(library), "key", "left").drop("key")


def infer_chemistry(composition: Column, electrolyte: Column) -> Column:
    """Electrolyte salt first, then a Na or Li token of the composition."""
    salt = F.lower(F.coalesce(electrolyte, F.lit("")))
    has = lambda *names: F.greatest(*[salt.contains(n) for n in names])
    text = F.coalesce(composition, F.lit(""))
    return (
        F.when(has("napf6", "naclo4", "natfsi"), "Na-ion")
        .when(has("lipf6", "litfsi", "libf4", "liclo4"), "Li-ion")
        .when(text.rlike("Na([^a-z]|$)"), "Na-ion")
        .when(text.rlike("Li([^a-z]|$)"), "Li-ion")
        .otherwise("Unknown")
    )


def counter_metal(stated: Column, chemistry: Column, library_ion: Column) -> Column:
    """Struct (metal, source): stated, then chemistry, then library, then assumed Na."""
    pick = lambda metal, source: F.struct(metal.alias("metal"), F.lit(source).alias("source"))
    return (
        F.when(F.length(F.trim(stated)) > 0, pick(F.substring(F.initcap(F.trim(stated)), 1, 2), "stated"))
        .when(chemistry == "Li-ion", pick(F.lit("Li"), "chemistry"))
        .when(chemistry == "Na-ion", pick(F.lit("Na"), "chemistry"))
        .when(library_ion.isNotNull(), pick(library_ion, "library"))
        .otherwise(pick(F.lit("Na"), "assumed"))
    )


def counter_mass_mg(metal: Column, diameter_mm: Column | None = None, thickness_mm: Column | None = None) -> Column:
    """Mass of a metal disc from its geometry and density."""
    d = F.coalesce(diameter_mm, F.lit(COUNTER_DIAMETER_MM)) if diameter_mm is not None else F.lit(COUNTER_DIAMETER_MM)
    t = F.coalesce(thickness_mm, F.lit(COUNTER_THICKNESS_MM)) if thickness_mm is not None else F.lit(COUNTER_THICKNESS_MM)
    density = F.when(metal == "Na", METAL_DENSITY["Na"]).otherwise(METAL_DENSITY["Li"])
    radius = d / 2 / 10
    return F.lit(math.pi) * radius * radius * (t / 10) * density * 1000.0


def c_rate(current_a: Column, mass_mg: Column, theoretical_mAh_g: Column) -> Column:
    """Current over the current that passes the theoretical capacity in one hour."""
    return F.when(
        (mass_mg > 0) & (theoretical_mAh_g > 0), current_a / ((mass_mg / 1000.0) * theoretical_mAh_g / 1000.0)
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (keeps expressions small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounded from the exact binary value (half to even).

    The product with 100 is split into its rounded part and the exact
    remainder, which decides the cases that look like a tie.
    """

    def text(c: Column) -> Column:
        p = c * 100.0
        high = c * 134217729.0 - (c * 134217729.0 - c)
        rest = (high * 100.0 - p) + (c - high) * 100.0
        tie = (p - F.floor(p)) == 0.5
        cents = F.when(tie & (rest > 0), F.floor(p) + 1).when(tie & (rest < 0), F.floor(p)).otherwise(F.bround(p)).cast("long")
        return _let(
            cents,
            lambda k: F.concat(F.floor(k / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0")),
        )

    return _let(value, text)


def snap_c_rate(rate: Column) -> Column:
    """Nearest conventional rate when within ten per cent in log space."""
    rates = F.array(*[F.lit(r) for r in CONVENTIONAL_RATES])

    def pick(c: Column) -> Column:
        near = F.array_min(F.transform(rates, lambda r: F.struct(F.abs(F.log(r / c)).alias("d"), r.alias("r"))))
        return _let(near, lambda n: F.when(n["d"] <= math.log(1.0 + RATE_SNAP), n["r"]).otherwise(c))

    return F.when(rate > 0, _let(rate, pick)).otherwise(rate)


def format_c_rate(rate: Column, snap: bool = True) -> Column:
    """"C/10" below one, "2C" above, two decimals when neither is a whole number."""

    def text(c: Column) -> Column:
        whole = lambda x: F.abs(x - F.bround(x)) < 0.05
        plain = F.concat(two_decimals(c), F.lit("C"))
        below = F.when(whole(1.0 / c), F.concat(F.lit("C/"), F.bround(1.0 / c).cast("int").cast("string"))).otherwise(plain)
        above = F.when(whole(c), F.concat(F.bround(c).cast("int").cast("string"), F.lit("C"))).otherwise(plain)
        return F.when(c < 1.0, below).otherwise(above)

    return F.when(rate > 0, _let(snap_c_rate(rate) if snap else rate, text)).otherwise("?C")


def mv_to_samples(mv: Column, mean_step_v: Column) -> Column:
    """Number of samples spanning ``mv`` at a mean voltage step, to the nearest (half to even), at least one."""
    return F.greatest(F.lit(1), F.bround(mv / 1000.0 / mean_step_v).cast("int"))


def erf(x: Column) -> Column:
    """Error function, from the series whose terms all have one sign; 1 beyond 6."""
    def series(near: Column) -> Column:
        def add(a: Column, k: Column) -> Column:
            term = a["term"] * 2.0 * near * near / (2 * k + 1)
            return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

        total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(near.alias("term"), near.alias("total")), add, lambda a: a["total"])
        return F.least(F.lit(1.0), total * F.exp(-near * near) * 2.0 / math.sqrt(math.pi))

    # An array of one: what a lambda refers to outside is computed anew for every term.
    return F.signum(x) * F.transform(F.array(F.least(F.abs(x), F.lit(6.0))), series)[0]


def pseudo_voigt(x: Column, area: Column, centre: Column, sigma: Column, fraction: Column) -> Column:
    """Gaussian/Lorentzian mix of one width (half-width at half height = sigma) and unit mixing."""
    gauss_sigma = sigma / math.sqrt(2.0 * math.log(2.0))
    gauss = F.exp(-(x - centre) * (x - centre) / (2.0 * gauss_sigma * gauss_sigma)) / (
        gauss_sigma * math.sqrt(2.0 * math.pi)
    )
    lorentz = sigma / math.pi / ((x - centre) * (x - centre) + sigma * sigma)
    return area * ((1.0 - fraction) * gauss + fraction * lorentz)


def pseudo_voigt_height(area: Column, sigma: Column, fraction: Column) -> Column:
    return area * (
        (1.0 - fraction) / (sigma / math.sqrt(2.0 * math.log(2.0)) * math.sqrt(2.0 * math.pi)) + fraction / (math.pi * sigma)
    )


def rect_pseudo_voigt(x: Column, area: Column, centre: Column, width: Column, sigma: Column, fraction: Column) -> Column:
    """Pseudo-Voigt smeared evenly over ``width``; the plain one where that is 1 mV or less."""
    gauss_sigma = sigma / math.sqrt(2.0 * math.log(2.0))
    high, low = x - centre + width / 2.0, x - centre - width / 2.0
    gauss = (erf(high / (gauss_sigma * math.sqrt(2.0))) - erf(low / (gauss_sigma * math.sqrt(2.0)))) / (2.0 * width)
    lorentz = (F.atan(high / sigma) - F.atan(low / sigma)) / (math.pi * width)
    smeared = area * ((1.0 - fraction) * gauss + fraction * lorentz)
    return F.when(width > 0.001, smeared).otherwise(pseudo_voigt(x, area, centre, sigma, fraction))


def split_rect_pseudo_voigt(x: Column, area: Column, centre: Column, width: Column, left: Column, right: Column, fraction: Column) -> Column:
    """As rect_pseudo_voigt, with a width parameter for each side; both sides meet at the same height, the area is kept."""
    one, zero = F.lit(1.0), F.lit(0.0)
    shape = lambda at, s: rect_pseudo_voigt(at, one, zero, width, s, fraction)
    top_left, top_right = shape(zero, left), shape(zero, right)
    side = F.when(x < centre, shape(x - centre, left) / top_left).otherwise(shape(x - centre, right) / top_right)
    return area * side / (0.5 * (1.0 / top_left + 1.0 / top_right))


def split_pseudo_voigt(x: Column, area: Column, centre: Column, left: Column, right: Column, fraction: Column) -> Column:
    """Pseudo-Voigt with a half-width of its own on each side of the centre; the area is kept."""
    u = (x - centre) / F.when(x < centre, left).otherwise(right)
    gauss = math.sqrt(math.log(2.0) / math.pi) * F.exp(-math.log(2.0) * u * u)
    return area * 2.0 / (left + right) * ((1.0 - fraction) * gauss + fraction / (math.pi * (1.0 + u * u)))


def split_pseudo_voigt_height(area: Column, left: Column, right: Column, fraction: Column) -> Column:
    return area * 2.0 / (left + right) * ((1.0 - fraction) * math.sqrt(math.log(2.0) / math.pi) + fraction / math.pi)


def gaussian_mass_outside(centre: Column, sigma: Column, low: Column, high: Column) -> Column:
    """Share of a Gaussian that lies outside [low, high]."""
    gauss_sigma = sigma / math.sqrt(2.0 * math.log(2.0))
    z = lambda edge: (edge - centre) / (gauss_sigma * math.sqrt(2.0))
    return 1.0 - (erf(z(high)) - erf(z(low))) / 2.0
