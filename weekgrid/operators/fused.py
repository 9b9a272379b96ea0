"""A complete table profile from one scan and one shuffle.

Every row becomes its (column, value) pairs, counted before they are shuffled; a hot value is one row of each task. Missing shares, distinct
counts, most frequent and largest values, moments, quantiles, id and date checks are all functions of (column, value, n), a table of
distinct values. Two columns that no table has take part: a digest of the whole row, for repeated rows, and the days between the ends of an
interval. Coverage between tables is a join of their counted values.

NaN counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import lenient_date, number, ratio
from ..session import stored
from .cleaning import columns_like
from .profile import numeric_columns, text_columns
from .ranking import counted_quantiles

ROW, DAYS = "*row", "*days"
REPORT = ["table", "section", "column", "metric", "value", "text"]
HIGH_MISSING = 50.0  # percent
HIGH_DISTINCT = 0.9
MOSTLY_DATES = 10.0  # percent that has to parse
LARGEST, FREQUENT = 5, 10
LIMITS = {"height": (140, 220), "weight": (45, 120)}  # plausible values


def _quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def _day(df: DataFrame, c: str) -> Column:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return _quoted(c).cast("date") if isinstance(df.schema[c].dataType, kinds) else lenient_date(_quoted(c))


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) of every column, null values included, and of the two derived ones."""
    def text(c: str) -> Column:
        plain = _quoted(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            plain = F.when(~F.isnan(plain), plain)
        return plain.cast("string")

    hashable = [_quoted(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    pairs = {c: text(c) for c in df.columns}
    # Nulls have to differ from empty strings, so the digest also sees which values are null.
    nulls = [c.isNull() for c in hashable]
    digest = F.concat_ws(":", F.xxhash64(*hashable, *nulls).cast("string"), F.xxhash64(F.lit(1), *nulls, *hashable).cast("string"))
    pairs[ROW] = digest
    starts, ends = columns_like(df.columns, "start", "from"), columns_like(df.columns, "end", "until")
    if starts and ends:
        pairs[DAYS] = F.datediff(_day(df, ends[0]), _day(df, starts[0])).cast("string")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in pairs.items()])
    return df.select(F.explode(entries).alias("_e")).groupBy("_e.column", "_e.value").agg(F.count(F.lit(1)).alias("n"))


def _cells(rows: DataFrame, section: str, metrics: dict[str, Column], column: Column | None = None) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    own = (column if column is not None else F.col("column")).alias("column")
    cells = rows.select(F.lit(section).alias("section"), own, F.explode(entries).alias("_e"))
    return cells.select("section", "column", "_e.metric", "_e.value", F.lit(None).cast("string").alias("text"))


def _numbers(counts: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of columns read as numbers; values that are none are left out."""
    numeric = counts.filter(F.col("column").isin(names)).select("column", number("value").alias("value"), "n")
    return numeric.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, order: list[Column], k: int, section: str, value: Column, text: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))  # Spark keeps the first k of each task only
    rows = counts.withColumn("_place", place).filter(F.col("_place") <= k)
    return rows.select(F.lit(section).alias("section"), "column", F.col("_place").cast("string").alias("metric"), value.cast("double").alias("value"), text.alias("text"))


def profile_counts(counts: DataFrame, df: DataFrame) -> DataFrame:
    """(section, column, metric, value, text) from the counted values of ``df``, of which only the schema is used."""
    numeric, texts = numeric_columns(df), text_columns(df)
    dated = [c for c in df.columns if any(w in c.lower() for w in S.DATE_KEYWORDS)]
    named = columns_like(df.columns, *S.ID_KEYWORDS)
    ids = [c for c in df.columns if c in named or c.lower() == "id"]
    filled = F.when(F.col("value").isNotNull(), F.col("n"))
    # One row for each column: everything that needs totals only.
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.count("value").alias("distinct"),
        F.sum(F.col("n") - 1).alias("repeats"),
    )
    real = totals.filter(~F.col("column").isin(ROW, DAYS))
    missing = 100 - ratio(F.col("filled") * 100, F.col("rows"))
    unique = ratio(F.col("distinct"), F.col("rows"))
    parts = [
        _cells(
            totals.filter(F.col("column") == ROW), "basic",
            {"n_rows": F.col("rows"), "n_columns": F.lit(len(df.columns)), "duplicate_rows": F.col("repeats")}, F.lit("*"),
        ),
        _cells(real, "missing", {"missing_pct": missing, "high_missing": (missing > HIGH_MISSING).cast("int"), "n_unique": F.col("distinct")}),
    ]
    if texts:
        own = counts.filter(F.col("column").isin(texts) & F.col("value").isNotNull())
        parts.append(_cells(real.filter(F.col("column").isin(texts)), "categorical", {"high_cardinality": (unique > HIGH_DISTINCT).cast("int")}))
        parts.append(_ranked(own, [F.desc("n"), F.col("value")], FREQUENT, "frequent", F.col("n"), F.col("value")))
    if ids:
        key = (F.col("distinct") == F.col("rows")).cast("int")
        parts.append(_cells(real.filter(F.col("column").isin(ids)), "ids", {"null_pct": missing, "uniqueness": unique, "likely_key": key}))
    first = {w: next((c for c in df.columns if w in c.lower()), None) for w in ("minute", *LIMITS)}
    checked = [c for c in first.values() if c]
    numbers = _numbers(counts, [*dict.fromkeys([*numeric, *checked]), DAYS])
    weight = F.col("n")
    sums = numbers.groupBy("column").agg(F.sum("n").alias("count"), ratio(F.sum(F.col("value") * weight), F.sum("n")).alias("mean"))
    # Around the mean, so that large values don't cancel.
    spread = numbers.join(sums.select("column", "mean"), "column").groupBy("column").agg(
        F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * weight).alias("_squares"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quantiles = counted_quantiles(numbers, list(points.values())).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in points.items()]
    )
    described = sums.join(spread, "column").join(quantiles, "column")
    deviation = F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))
    moments = {"count": F.col("count"), "mean": F.col("mean"), "std": deviation, **{m: F.col(m) for m in ("min", "p25", "p50", "p75", "max")}}
    if numeric:
        parts.append(_cells(described.filter(F.col("column").isin(numeric)), "numeric", moments))
        # A repeated value is one row here; it takes as many places as it occurs.
        order = Window.partitionBy("column").orderBy(F.desc("value"))
        top = numbers.filter(F.col("column").isin(numeric)).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= LARGEST)
        top = top.withColumn("_before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < LARGEST)
        places = top.withColumn("place", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("n"), F.lit(LARGEST)))))
        parts.append(places.select(F.lit("largest").alias("section"), "column", F.col("place").cast("string").alias("metric"), "value", F.lit(None).cast("string").alias("text")))
    if dated:
        day = lenient_date(F.col("value"))
        parsed = counts.filter(F.col("column").isin(dated)).withColumn("day", day).groupBy("column").agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.lit(0)).alias("invalid"),
            F.unix_date(F.min("day")).alias("first_day"), F.unix_date(F.max("day")).alias("last_day"),
        )
        success = 100 - ratio(F.col("invalid") * 100, F.col("rows"))
        parts.append(_cells(parsed.filter(success > MOSTLY_DATES), "dates", {"success_pct": success, "first_day": F.col("first_day"), "last_day": F.col("last_day"), "invalid": F.col("invalid")}))
    checks = _checks(counts, numbers, totals, described, first, any(columns_like(df.columns, "start", "from")) and any(columns_like(df.columns, "end", "until")))
    out = parts[0]
    for part in [*parts[1:], *checks]:
        out = out.unionByName(part)
    return out


def _checks(counts, numbers, totals, described, first: dict[str, str | None], interval: bool) -> list[DataFrame]:
    """Plausibility of intervals, minutes, heights and weights."""
    def of(column: str, aggregates: dict[str, Column], name: str) -> DataFrame:
        row = numbers.filter(F.col("column") == column).agg(*[a.alias(m) for m, a in aggregates.items()])
        return _cells(row, "checks", {m: F.coalesce(F.col(m), F.lit(0)) for m in aggregates}, F.lit(name))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")))

    v = F.col("value")
    out = []
    if interval:
        out.append(of(DAYS, {"negative_days": total(v < 0), "zero_days": total(v == 0), "time_loss_7plus": total(v >= S.MIN_DAYS_OUT)}, "injuries"))
        out.append(_cells(described.filter(F.col("column") == DAYS), "checks", {"median_days": F.col("p50")}, F.lit("injuries")))
    if minutes := first["minute"]:
        own = numbers.filter(F.col("column") == minutes).groupBy("column").agg(F.coalesce(total(v == 0), F.lit(0)).alias("_zero"))
        joined = totals.filter(F.col("column") == minutes).join(own, "column").join(described, "column")
        out.append(_cells(joined, "checks", {"zero_minutes_pct": ratio(F.col("_zero") * 100, F.col("rows")), "min": F.col("min"), "max": F.col("max"), "median": F.col("p50")}, F.lit("minutes")))
    for word, (lowest, highest) in LIMITS.items():
        if column := first[word]:
            out.append(of(column, {"outliers": total((v < lowest) | (v > highest))}, word))
    return out


#: Facts, the table they point to, and the key.
REFERENCES = (("appearances", "games", "game_id"), ("appearances", "players", "player_id"))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """The profiles of all tables, and how far the facts reach the tables they point to."""
    counted = {name: stored(value_counts(df)) for name, df in tables.items()}
    out = None
    for name, df in tables.items():
        part = profile_counts(counted[name], df).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    for facts, other, key in REFERENCES:
        if facts in tables and other in tables and key in tables[facts].columns and key in tables[other].columns:
            own = counted[facts].filter(F.col("column") == key)
            known = counted[other].filter((F.col("column") == key) & F.col("value").isNotNull()).select("value", F.lit(1).alias("_known"))
            hit = own.join(known, "value", "left").agg(ratio(F.sum(F.when(F.col("_known") == 1, F.col("n")).otherwise(0)) * 100, F.sum("n")).alias("pct"))
            covered = _cells(hit, "integrity", {f"in_{other}_pct": F.col("pct")}, F.lit(key)).withColumn("table", F.lit(facts))
            out = out.unionByName(covered)
    return out.select(*REPORT)
