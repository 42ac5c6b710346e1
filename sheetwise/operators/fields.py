"""Values of a form's fields from detections, as facts ``(keys, section, key, subkey, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import nearest
from sheetwise.operators.boxes import landmark_values
from sheetwise.operators.legend import concat_by, fifteen_minute_intervals
from sheetwise.schema import KEYS

#: Landmarks of physiological indicators with the smallest and largest plausible value (fixed values).
PLAUSIBLE = {
    "spo2": (40, 100), "etco2": (5, 99), "fio2": (18, 100), "temperature": (32, 41),
    "tidal_volume": (5, 1000), "respiratory_rate": (5, 50), "urine_output": (0, 999), "blood_loss": (0, 999),
}
HTO = ("hundreds", "tens", "ones")
FIELD = "form string, name string, section string, key string, rule string, pos int, size int, dot int"


def _rows(form: str, section: str, key: str, names: list[str], rule: str, dot: int = 0) -> list[tuple]:
    return [(form, n, section, key, rule, i, len(names), dot) for i, n in enumerate(names)]


def front_fields() -> list[tuple]:
    """Digit boxes of the front: drug codes, tube size, timing. All digits of a field are needed."""
    out = []
    for i in range(11):
        out += _rows("front", "codes", f"row{i:02d}", [f"code_row{i:02d}_col{c}" for c in range(3)], "all")
    out += _rows("front", "ett_size", "ett_size", ["ett_n_whole", "ett_n_frac"], "all", 1)
    for what in ("surg", "anes"):
        for when in ("start", "end"):
            for unit in ("hr", "min"):
                key = f"{what}_{when}_{unit}"
                out += _rows("front", "timing", key, [f"{key}_tens", f"{key}_ones"], "all")
    return out


#: Digits of each lab test, in order, and after how many of them the point stands (fixed formats).
LABS = {
    **{t: (("tens", "ones", "frac"), 2) for t in ("hgb", "hct", "urea", "creatinine")},
    **{t: (HTO, 0) for t in ("plt", "na", "cl")},
    **{t: (("ones", "frac"), 1) for t in ("k", "ca")},
    **{t: (("ones", "tenths", "hundredths"), 1) for t in ("mg", "po4")},
    "albumin": (("ones", "tens"), 1),
}


def back_fields() -> list[tuple]:
    """Digit boxes of the back. Times need all digits; other fields any, and have a space for a missing one."""
    out = []
    for unit in ("year", "month", "day", "hour", "min"):
        out += _rows("back", "timing", unit, [f"time_of_assessment_{unit}_{d}" for d in ("tens", "ones")], "all")
    for name in ("age", "height", "weight"):
        out += _rows("back", name, name, [f"{name}_{d}" for d in HTO], "any")
    for section in ("preop", "pacu"):
        for vital in ("sys", "dia", "hr", "rr", "ox"):
            out += _rows("back", f"{section}_vitals", vital, [f"{section}_{vital}_{d}" for d in HTO], "any")
    for test, (digits, dot) in LABS.items():
        out += _rows("back", "lab_values", test, [f"{test}_{d}" for d in digits], "any", dot)
    return out + _rows("back", "aldrete_score", "aldrete_score", ["aldrete_tens", "aldrete_ones"], "any")


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(front_fields() + back_fields(), FIELD)


def digit_facts(matched: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Facts of all digit-box fields from one nearest-neighbour join (keys, form, name, category).

    Rule ``all`` gives a value only if every digit is there; rule ``any`` has a space for a missing one and trims the ends. A point stands after
    ``dot`` digits.
    """
    met = matched.join(nearest.small(fields), ["form", "name"])
    digit = lambda i: F.coalesce(F.max(F.when(F.col("pos") == i, F.col("category"))), F.lit(" "))
    by = met.groupBy(*keys, "section", "key", "rule", "size", "dot").agg(*[digit(i).alias(f"d{i}") for i in range(3)], F.count_distinct("pos").alias("found"))
    parts = []
    for i in range(3):
        parts += [F.when((F.col("dot") == i) & (F.col("dot") > 0), ".").otherwise(""), F.when(F.col("size") > i, F.col(f"d{i}")).otherwise("")]
    value = F.concat(*parts)
    whole = by.where((F.col("rule") == "any") | (F.col("found") == F.col("size")))
    return whole.select(*keys, "section", "key", F.lit("").alias("subkey"), F.when(F.col("rule") == "any", F.trim(value)).otherwise(value).alias("value"))


def section(facts: DataFrame, *names: str) -> DataFrame:
    return facts.where(F.col("section").isin(list(names)))


# Handwritten rows of the front -----------------------------------------------------------------------------------------------

def inhaled_volatile_region(digits: DataFrame, landmarks: DataFrame, keys: tuple[str, ...] = KEYS, fail: bool = False) -> DataFrame:
    """Digits with a centre strictly between the landmark rows above and below. Sheets with a pair of landmarks missing give no rows, or an error."""
    y = G.center_y()
    names = {"a": "inhaled_volatile", "b": "inhaled_exhaled", "c": "fluid_blood_product", "d": "total"}
    found = landmark_values(landmarks, {k: (n, y) for k, n in names.items()}, keys)
    bounds = found.select(*keys, G.mean_ignoring_nulls(F.col("a"), F.col("b")).alias("_top"), G.mean_ignoring_nulls(F.col("c"), F.col("d")).alias("_bottom"))
    if fail:
        bounds = bounds.withColumn("_top", G.raise_unless(F.col("_top").isNotNull() & F.col("_bottom").isNotNull(), "landmarks of the inhaled volatile row are missing", F.col("_top")))
    y = G.stated(y)
    return digits.join(bounds, list(keys)).where((G.stated(F.col("_top")) < y) & (y < G.stated(F.col("_bottom")))).drop("_top", "_bottom")


def digits_to_decimal(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One digit is a tenth, two are units and tenths; other numbers of digits give no row."""
    joined = concat_by("cx", by, df)
    value = F.when(F.col("n") == 1, F.concat(F.lit("0."), F.col("digits"))).when(F.col("n") == 2, F.concat_ws(".", F.substring("digits", 1, 1), F.substring("digits", 2, 1)))
    return joined.where("n <= 2").select(*by, value.alias("value"))


def inhaled_volatile(digits: DataFrame, legend: DataFrame, landmarks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Gas readings by 15-minute interval."""
    here = inhaled_volatile_region(digits, landmarks, keys).withColumn("cx", G.center_x())
    met = nearest.in_intervals(here, fifteen_minute_intervals(legend, keys), F.col("cx"), keys)
    return digits_to_decimal(met, (*keys, "name")).select(*keys, F.lit("inhaled_volatile").alias("section"), F.col("name").alias("key"), F.lit("").alias("subkey"), "value")


def indicator_for_box(digits: DataFrame, landmarks: DataFrame, width: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``indicator``: the nearest indicator landmark, by centre y, on the left half of the sheet (the last one of a name counts)."""
    own = landmarks.where(F.col("category").isin(sorted(PLAUSIBLE)) & (G.center_x() < 0.5 * width))
    rows = own.groupBy(*keys, F.col("category").alias("indicator")).agg(F.max_by(G.center_y(), "ord").alias("indicator_y"))
    return nearest.nearest_label_1d(digits, rows, G.center_y(), "indicator_y", "indicator", keys)


def shift_temperature(value: Column) -> Column:
    """A point before the last character."""
    n = F.length(value)
    return F.concat(F.substring(value, F.lit(1), n - 1), F.lit("."), F.substring(value, n, F.lit(1)))


def drop_implausible(facts: DataFrame) -> DataFrame:
    """Facts whose key is an indicator with a value in its range, ends included."""
    spark = facts.sparkSession
    ranges = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in PLAUSIBLE.items()], "key string, least double, most double")
    return facts.join(F.broadcast(ranges), "key").where(F.expr("try_cast(value as double) between least and most")).select(*facts.columns)


def physiological_indicators(digits: DataFrame, legend: DataFrame, landmarks: DataFrame, width: float, height: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Readings of the indicator rows by 15-minute interval, temperature with its point, implausible ones left out."""
    lower = digits.where((F.col("top") > 0.5 * height) & (F.col("top") < 0.95 * height)).withColumn("cx", G.center_x())
    tagged = indicator_for_box(lower, landmarks, width, keys)
    met = nearest.in_intervals(tagged, fifteen_minute_intervals(legend, keys), F.col("cx"), keys)
    numbers = concat_by("cx", (*keys, "indicator", "name"), met)
    plain = F.expr("cast(cast(try_cast(digits as decimal(38,0)) as decimal(38,0)) as string)")
    value = F.when(F.col("indicator") == "temperature", shift_temperature(plain)).otherwise(plain)
    return drop_implausible(numbers.select(*keys, F.lit("physiological_indicators").alias("section"), F.col("indicator").alias("key"), F.col("name").alias("subkey"), value.alias("value")))


# Blood pressure and heart rate -----------------------------------------------------------------------------------------------

def bp_hr_area_filter(points: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Symbols that touch the chart between the legends' envelopes."""
    mins, mmhg = F.col("unit") == "mins", F.col("unit") == "mmhg"
    edge = clusters.groupBy(*keys).agg(
        F.min(F.when(mmhg, F.col("env_top"))).alias("_top"), F.max(F.when(mmhg, F.col("env_bottom"))).alias("_bottom"),
        F.min(F.when(mins, F.col("env_left"))).alias("_left"), F.max(F.when(mins, F.col("env_right"))).alias("_right"),
    )
    s = lambda c: G.stated(F.col(c))
    return points.join(edge, list(keys)).where((s("bottom") > s("_top")) & (s("top") < s("_bottom")) & (s("left") > s("_left")) & (s("right") < s("_right"))).drop("_top", "_bottom", "_left", "_right")


def find_timestamp(points: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``label`` of the minute cluster whose envelope centre is closest to the keypoint."""
    return nearest.nearest_label_1d(points, clusters.where("unit = 'mins'"), F.col("kp_x"), "env_cx", "label", keys)


def find_value(points: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``reading``: the smaller of the two nearest labels plus tenths of the distance between them, as whole units of a step of 10."""
    near = nearest.two_nearest_1d(points, clusters.where("unit = 'mmhg'"), F.col("kp_y"), "env_cy", keys=keys)
    low = F.when(F.col("v1") <= F.col("v2"), F.col("p1")).otherwise(F.col("p2"))
    part = F.try_divide(F.abs(low - F.col("kp_y")), F.abs(F.col("p1") - F.col("p2"))) * 10  # at a stated precision before it is cut
    return near.withColumn("reading", F.least("v1", "v2") + G.stated(part).cast("int")).drop("v1", "p1", "v2", "p2")


def best_per_group(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The most confident row of each group, the first of equals."""
    cols = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(F.col("confidence"), -F.col("ord"))).alias("_d")).select(*by, "_d.*")


def heart_rate_and_blood_pressure(points: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One reading of each kind for each time label."""
    best = best_per_group(find_timestamp(bp_hr_area_filter(points, clusters, keys), clusters, keys), (*keys, "label", "category"))
    unit = F.when(F.col("category") == "heart_rate", "_bpm").otherwise("_mmhg")
    return find_value(best, clusters, keys).select(*keys, F.lit("bp_and_hr").alias("section"), F.col("label").alias("key"), F.col("category").alias("subkey"), F.concat(F.col("reading").cast("string"), unit).alias("value"))


# Checkboxes and drug rows ----------------------------------------------------------------------------------------------------

SIDES = ("intraoperative", "preoperative")


def checkboxes(det: DataFrame, centroids: DataFrame, width: Column, height: Column, side: str, max_dist: float | None = None, winner: str = "last", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """State of each named box. Of several detections nearest to one box, the last by ``ord`` counts, or with winner ``best`` the first."""
    if side not in SIDES or winner not in ("last", "best"):
        raise ValueError(f"side is one of {SIDES}, winner last or best")
    near = nearest.nearest_centroid(det, centroids, width, height, max_dist, keys)
    pick = F.max_by if winner == "last" else F.min_by
    return near.groupBy(*keys, "name").agg(pick("category", "ord").alias("value")).select(*keys, F.lit("checkboxes").alias("section"), F.col("name").alias("key"), F.lit("").alias("subkey"), "value")


def drug_dosage_region(digits: DataFrame, landmarks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Digits strictly inside the rectangle that four landmarks span; sheets that lack one give no rows."""
    x, y = G.center_x(), G.center_y()
    names = {"d": "drug_name", "u": "units", "v": "inhaled_volatile", "e": "inhaled_exhaled"}
    at = landmark_values(landmarks, {f"{k}{c}": (n, e) for k, n in names.items() for c, e in (("x", x), ("y", y))}, keys)
    edge = at.select(*keys, ((F.col("dx") + F.col("vx")) / 2).alias("_l"), ((F.col("dy") + F.col("uy")) / 2).alias("_t"), ((F.col("ux") + F.col("ex")) / 2).alias("_r"), ((F.col("vy") + F.col("ey")) / 2).alias("_b"))
    x, y, s = G.stated(x), G.stated(y), lambda c: G.stated(F.col(c))
    return digits.join(edge, list(keys)).where((s("_l") < x) & (x < s("_r")) & (s("_t") < y) & (y < s("_b"))).drop("_l", "_t", "_r", "_b")
