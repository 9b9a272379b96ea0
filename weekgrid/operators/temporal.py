"""Point-in-time features: dated facts read at probe dates in one shuffle and one sort.

Facts are first reduced to one row per (entity, day), so a window partition never holds more rows than a
small multiple of the days there are, however many raw rows a single entity has. Facts of every family are
then unioned with the probes and shuffled once by entity.

Behind that shuffle the windows are swept rather than re-read: a fact enters a window on one day and leaves
it on another, so it is repeated (locally) at those moments with +m and -m, and a window sum is a running
total. All features then share one order and one ``ROWS UNBOUNDED PRECEDING .. CURRENT ROW`` frame, whose
cost per row depends neither on the length nor on the number of windows. Only bounded maxima and minima,
which cannot be undone, keep a frame of their own over the same order.

Boundary conventions (t = probe date), each stated once here:

* prior window of w days         [t-w, t-1]     ``prior(w)``
* anything strictly before t     (.., t-1]      ``before()``
* as-of, t included              (.., t-lag]    ``as_of(lag)``
* forward horizon of h days      [t+1, t+h]     ``ahead(h)``
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_number

DAY = "_day"
FAMILY = "_family"
MOVE = "_move"
CODE = "_code"
MOMENT = "_moment"
PROBE_ROW = "_is_probe"
OPEN = None

# A day is cut into four moments, so that facts sort before or after the probe of the same day.
MOMENTS = 4
EARLY, PROBE, LATE = 0, 1, 2


@dataclass(frozen=True)
class Frame:
    """Days relative to the probe, both ends included; ``low`` is OPEN for "since ever"."""

    low: int | None
    high: int

    @property
    def enter(self) -> int:
        """Moment, relative to a fact's day, from which probes see the fact."""
        return self._moment(-self.high)

    @property
    def leave(self) -> int | None:
        """Moment from which they no longer do."""
        return None if self.low is OPEN else self._moment(-self.low + 1)

    @staticmethod
    def _moment(first_day: int) -> int:
        # Seen from probes of day ``first_day`` on: sorted before those probes.
        return first_day * MOMENTS + EARLY


def prior(days: int) -> Frame:
    return Frame(-days, -1)


def before() -> Frame:
    return Frame(OPEN, -1)


def as_of(lag: int = 0) -> Frame:
    return Frame(OPEN, -lag)


def ahead(days: int) -> Frame:
    return Frame(1, days)


@dataclass(frozen=True)
class Feature:
    """``name`` = aggregate of ``measure`` over ``frame``; ``finish`` maps the raw value to the output.

    ``agg`` is one of sum, max, min, last (latest non-null by day) or ``day`` (latest day on which the
    measure is non-null). ``finish`` gets the aggregate and the probe's day number.
    """

    name: str
    agg: str
    measure: str
    frame: Frame
    finish: Callable[[Column, Column], Column] = lambda value, day: value


def daily(df: DataFrame, key: str, day: str | Column, **measures: Column) -> DataFrame:
    """One row per (entity, day). Partial aggregation runs before the shuffle, so hot entities shrink first.

    Rows without an entity or a date cannot take part and are dropped here, once.
    """
    day_col = F.col(day) if isinstance(day, str) else day
    keyed = df.withColumn(DAY, day_number(day_col)).filter(F.col(key).isNotNull() & F.col(DAY).isNotNull())
    return keyed.groupBy(key, DAY).agg(*[expr.alias(name) for name, expr in measures.items()])


def _swept(feature: Feature) -> bool:
    """Whether the running frame serves the feature: open frames always, bounded ones when undoable."""
    return feature.frame.low is OPEN or feature.agg == "sum"


def _moves(features: Sequence[Feature]) -> list[int]:
    moves = {f.frame.enter for f in features}
    moves |= {f.frame.leave for f in features if _swept(f) and f.frame.leave is not None}
    return sorted(moves)


def _read(feature: Feature, contribution: Column, order) -> Column:
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    if _swept(feature):
        if feature.agg == "last":
            return F.last(contribution, ignorenulls=True).over(running)
        return {"sum": F.sum, "max": F.max, "min": F.min, "day": F.max}[feature.agg](contribution).over(running)
    # Entered at day - high, so a frame of (high - low) days back from the probe holds exactly its facts.
    span = (feature.frame.high - feature.frame.low) * MOMENTS + PROBE
    bounded = order.rangeBetween(-span, 0)
    return {"max": F.max, "min": F.min, "day": F.max}[feature.agg](contribution).over(bounded)


NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass(frozen=True)
class _Slot:
    """Where a measure travels: families share columns, as each fact row belongs to one family."""

    column: str
    family: int
    dtype: str


def _into_slots(
    facts: Sequence[DataFrame], key: str, used: set[str]
) -> tuple[list[DataFrame], dict[str, _Slot]]:
    slots: dict[str, _Slot] = {}
    slotted = []
    for i, family in enumerate(facts):
        taken: dict[str, int] = {}
        columns = []
        for name, dtype in family.dtypes:
            if name in (key, DAY) or name not in used:
                continue
            pool = "double" if dtype in NUMERIC else dtype
            n = taken[pool] = taken.get(pool, -1) + 1
            slot = _Slot(f"_s{n}_{''.join(c for c in pool if c.isalnum())}", i, dtype)
            slots[name] = slot
            columns.append(F.col(name).cast(pool).alias(slot.column))
        slotted.append(family.select(key, DAY, F.lit(i).alias(FAMILY), *columns))
    return slotted, slots


def at_probes(
    probes: DataFrame,
    key: str,
    date: str,
    facts: Sequence[DataFrame],
    features: Sequence[Feature],
) -> DataFrame:
    """Every probe row with its features added. ``facts`` come from :func:`daily`; measure names are unique."""
    columns = probes.columns
    families, slots = _into_slots(facts, key, {f.measure for f in features})
    stacked = probes.withColumn(DAY, day_number(date)).withColumn(FAMILY, F.lit(None).cast("int"))
    for family in families:
        stacked = stacked.unionByName(family, allowMissingColumns=True)

    # Every (family, move) has a small code. Codes keep the generated projection short enough for the JIT.
    per_family = [_moves([f for f in features if slots[f.measure].family == i]) for i in range(len(facts))]
    codes = {(i, m): n + 1 for n, (i, m) in enumerate((i, m) for i, ms in enumerate(per_family) for m in ms)}

    def literal(pairs: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(code).alias("code"), F.lit(move).alias("move")) for code, move in pairs])

    moves = F.when(F.col(FAMILY).isNull(), literal([(0, PROBE)]))
    for i, ms in enumerate(per_family):
        if ms:
            moves = moves.when(F.col(FAMILY) == i, literal([(codes[i, m], m) for m in ms]))
    # The one exchange carries compact daily rows; they are repeated only behind it.
    swept = stacked.repartition(F.col(key)).withColumn(MOVE, F.explode(moves))
    # Sorted while they are narrow: the window needs this order, and would else sort rows with a column for each feature.
    carried = sorted({slot.column for slot in slots.values()})
    swept = swept.select(
        *columns, DAY, F.col(f"{MOVE}.code").alias(CODE), (F.col(DAY) * MOMENTS + F.col(f"{MOVE}.move")).alias(MOMENT), *carried
    ).sortWithinPartitions(key, MOMENT)
    code = F.col(CODE)

    def contribution(feature: Feature) -> Column:
        slot = slots[feature.measure]
        measure = F.col(slot.column)
        if feature.agg == "day":
            measure = F.when(measure.isNotNull(), F.col(DAY))
        value = F.when(code == codes[slot.family, feature.frame.enter], measure)
        if _swept(feature) and feature.frame.leave is not None:
            value = value.when(code == codes[slot.family, feature.frame.leave], -measure)
        return value

    placed = swept.select(
        *columns, DAY, (code == 0).alias(PROBE_ROW), MOMENT,
        *[contribution(f).alias(f"_c{i}") for i, f in enumerate(features)],
    )
    order = Window.partitionBy(key).orderBy(MOMENT)
    raw = [_read(f, F.col(f"_c{i}"), order).alias(f"_r{i}") for i, f in enumerate(features)]
    windowed = placed.select(*columns, DAY, PROBE_ROW, *raw).filter(F.col(PROBE_ROW))

    def finished(i: int, feature: Feature) -> Column:
        value = F.col(f"_r{i}")
        if feature.agg in ("last", "max", "min"):
            value = value.cast(slots[feature.measure].dtype)
        return feature.finish(value, F.col(DAY)).alias(feature.name)

    return windowed.select(*columns, *[finished(i, f) for i, f in enumerate(features)])


#: Before and after every day of a table; their differences fit an int.
FIRST_DAY, LAST_DAY = -(1 << 29), 1 << 29


def at_weeks(
    spans: DataFrame, key: str, low: str, high: str, week: str, facts: Sequence[DataFrame], features: Sequence[Feature],
    ranged: bool = False,
) -> DataFrame:
    """Every seventh day from ``low`` to ``high`` of each span as ``week``, with the features of :func:`at_probes` on that day added.

    Features are constant between the days on which facts enter or leave their windows. So the windows run over those days
    alone, and weeks are expanded last, behind the shuffle and the sort, from the stretches between them: neither ever sees a
    weekly row, and the expansion streams. ``spans`` has few rows for each key (a player's seasons); they travel as one array.
    ``ranged``: partitions are ranges of the key; the rows of each are in its order either way.
    """
    columns = [c for c in spans.columns if c not in (key, low, high)]
    families, slots = _into_slots(facts, key, {f.measure for f in features})
    held = spans.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.collect_list(F.struct(day_number(low).alias("_low"), day_number(high).alias("_high"), *columns)).alias("_spans")
    )
    stacked = held.withColumn(DAY, F.lit(FIRST_DAY)).withColumn(FAMILY, F.lit(None).cast("int"))
    for family in families:
        stacked = stacked.unionByName(family, allowMissingColumns=True)

    def bounds(feature: Feature) -> list[int]:
        return [m // MOMENTS for m in (feature.frame.enter, feature.frame.leave) if m is not None]

    per_family = [sorted({m for f in features if slots[f.measure].family == i for m in bounds(f)}) for i in range(len(facts))]
    codes = {(i, m): n + 1 for n, (i, m) in enumerate((i, m) for i, ms in enumerate(per_family) for m in ms)}

    def literal(pairs: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(code).alias("code"), F.lit(move).alias("move")) for code, move in pairs])

    moves = F.when(F.col(FAMILY).isNull(), literal([(0, 0)]))
    for i, ms in enumerate(per_family):
        if ms:
            moves = moves.when(F.col(FAMILY) == i, literal([(codes[i, m], m) for m in ms]))
    dealt = stacked.repartitionByRange(F.col(key)) if ranged else stacked.repartition(F.col(key))
    swept = dealt.withColumn(MOVE, F.explode(moves))
    carried = sorted({slot.column for slot in slots.values()})
    begin, code = F.col(MOMENT), F.col(CODE)
    swept = swept.select(key, "_spans", F.col(f"{MOVE}.code").alias(CODE), (F.col(DAY) + F.col(f"{MOVE}.move")).alias(MOMENT), DAY, *carried)
    order = Window.partitionBy(key).orderBy(MOMENT)
    running = order.rowsBetween(Window.unboundedPreceding, 0)

    def raw(feature: Feature) -> Column:
        slot = slots[feature.measure]
        measure = F.col(slot.column)
        if feature.agg == "day":
            measure = F.when(measure.isNotNull(), F.col(DAY))
        enter, *leave = (codes[slot.family, m] for m in bounds(feature))
        value = F.when(code == enter, measure)
        if _swept(feature):
            value = value.when(code == leave[0], -measure) if leave else value
            if feature.agg == "last":
                return F.last(value, ignorenulls=True).over(running)
            return {"sum": F.sum, "max": F.max, "min": F.min, "day": F.max}[feature.agg](value).over(running)
        span = feature.frame.high - feature.frame.low
        return {"max": F.max, "min": F.min, "day": F.max}[feature.agg](value).over(order.rangeBetween(-span, 0))

    stretches = swept.select(
        key, MOMENT, F.lead(MOMENT, 1, LAST_DAY).over(order).alias("_next"),
        F.last("_spans", ignorenulls=True).over(running).alias("_spans"), *[raw(f).alias(f"_r{i}") for i, f in enumerate(features)],
    )
    # Of the rows of one day the last has seen them all; the others' stretches are empty.
    met = stretches.filter((F.col("_next") > begin) & F.col("_spans").isNotNull()).withColumn("_span", F.explode("_spans"))
    first = F.col("_span._low") + F.floor((F.greatest(begin - F.col("_span._low"), F.lit(0)) + 6) / 7).cast("int") * 7
    last = F.least(F.col("_span._high"), F.col("_next") - 1)
    met = met.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    weekly = met.withColumn(DAY, F.explode(F.sequence("_first", "_last", F.lit(7))))

    def finished(i: int, feature: Feature) -> Column:
        value = F.col(f"_r{i}")
        if feature.agg in ("last", "max", "min"):
            value = value.cast(slots[feature.measure].dtype)
        return feature.finish(value, F.col(DAY)).alias(feature.name)

    return weekly.select(
        key, F.date_from_unix_date(DAY).alias(week), *[F.col(f"_span.{c}").alias(c) for c in columns],
        *[finished(i, f) for i, f in enumerate(features)],
    )


def snapped(value: Column) -> Column:
    """Running totals of fractions leave residues near 1e-12; keep six decimals (whole numbers stay exact)."""
    return F.rint(value * 1e6) / 1e6


def or_zero(value: Column, day: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def total(value: Column, day: Column) -> Column:
    return F.coalesce(snapped(value), F.lit(0.0))


def or_zero_count(value: Column, day: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("int")


def at_least_zero(value: Column, day: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def flag(value: Column, day: Column) -> Column:
    return F.when(value > 0, 1).otherwise(0)


def days_since(missing: int) -> Callable[[Column, Column], Column]:
    return lambda value, day: F.coalesce(day - value, F.lit(missing)).cast("int")


def covers_probe(value: Column, day: Column) -> Column:
    """1 when the latest end of all intervals begun by t reaches t: some interval holds t."""
    return F.when(value >= day, 1).otherwise(0)


# --- the single-purpose forms -------------------------------------------------------------------------


def prior_sums(
    events: DataFrame, probes: DataFrame, key: str, event_date: str, probe_date: str, measure: str,
    windows: dict[str, int],
) -> DataFrame:
    """Sum of ``measure`` in [t-w, t) for each named window."""
    facts = daily(events, key, event_date, _m=F.sum(F.coalesce(F.col(measure), F.lit(0.0))))
    features = [Feature(name, "sum", "_m", prior(days), total) for name, days in windows.items()]
    return at_probes(probes, key, probe_date, [facts], features)


def as_of_value(
    facts: DataFrame, probes: DataFrame, key: str, fact_date: str, probe_date: str, value: str, out: str,
    lag: int = 0, tiebreak: str | None = None,
) -> DataFrame:
    """Latest ``value`` dated on or before t - lag; several values on one day resolve by ``tiebreak``."""
    # Wrapped in structs: the latest row decides even when its value or its tiebreak is missing.
    best = F.max_by(F.struct(F.col(value).alias("value")), F.struct(tiebreak or value))
    family = daily(facts, key, fact_date, _v=best)
    read = Feature(out, "last", "_v", as_of(lag), lambda found, day: found.getField("value"))
    return at_probes(probes, key, probe_date, [family], [read])


def horizon_flag(
    intervals: DataFrame, probes: DataFrame, key: str, start: str, probe_date: str, out: str, days: int
) -> DataFrame:
    """1 when some interval starts in (t, t + days]."""
    family = daily(intervals, key, start, _n=F.count(F.lit(1)))
    return at_probes(probes, key, probe_date, [family], [Feature(out, "sum", "_n", ahead(days), flag)])


def inside_flag(
    intervals: DataFrame, probes: DataFrame, key: str, start: str, end: str, probe_date: str, out: str
) -> DataFrame:
    """1 when start <= t <= end for some interval; an open end never matches."""
    family = daily(intervals, key, start, _end=F.max(day_number(end)))
    return at_probes(probes, key, probe_date, [family], [Feature(out, "max", "_end", as_of(), covers_probe)])


WEEK_BITS = 64  # weeks that a long holds as bits


def band_sum(
    events: DataFrame, probes: DataFrame, key: str, event_date: str, probe_date: str, measure: str,
    out: str, days: int,
) -> DataFrame:
    """The same prior sum as a literal band join, for every distinct probe row; kept as the independent form that audits recompute with.

    Probes that differ in their date only travel as bits: one row for each weekday and block of ``WEEK_BITS`` weeks, combined inside the tasks before the
    shuffle. They meet the facts of their bucket as one array, and become rows again behind the join.
    """
    facts = daily(events, key, event_date, _m=F.sum(F.coalesce(F.col(measure), F.lit(0.0))))
    columns, span = probes.columns, 7 * WEEK_BITS
    length = span * -(-days // span)  # of a bucket: whole blocks, and no window is longer
    own = [c for c in columns if c != probe_date]
    week = F.floor(F.col("_t") / 7)
    place = (F.col("_week") - F.col("_block") * WEEK_BITS).cast("int")
    asked = (
        probes.withColumn("_t", day_number(probe_date)).withColumn("_week", week).withColumn("_turn", F.col("_t") - F.col("_week") * 7)
        .withColumn("_block", F.floor(F.col("_week") / WEEK_BITS)).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
        .groupBy(*own, "_turn", "_block").agg(F.bit_or("_bit").alias("_asked"))
        .withColumn("_bucket", F.floor(F.col("_block") * span / length))
    )
    # Each fact lands in the at most two buckets that a window covering it can end in, so the join is an equi join on
    # (entity, bucket), and a bucket's array is bounded by its days.
    first, last = F.floor((F.col(DAY) + 1) / length), F.floor((F.col(DAY) + days) / length)
    held = facts.withColumn("_bucket", F.explode(F.sequence(first, last))).groupBy(key, "_bucket").agg(
        F.collect_list(F.struct(F.col(DAY).alias("day"), F.col("_m").alias("m"))).alias("_facts")
    )
    met = asked.join(held, on=[key, "_bucket"], how="left")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WEEK_BITS - 1)), lambda i: F.getbit("_asked", i) == 1)
    turns = F.transform(bits, lambda i: ((F.col("_block") * WEEK_BITS + i) * 7 + F.col("_turn")).cast("int"))
    single = met.withColumn("_t", F.explode(F.when(F.col("_block").isNull(), F.array(F.lit(None).cast("int"))).otherwise(turns)))
    seen = F.filter("_facts", lambda f: (f["day"] >= F.col("_t") - days) & (f["day"] < F.col("_t")))
    total = F.coalesce(F.aggregate(seen, F.lit(0.0), lambda s, f: s + f["m"]), F.lit(0.0))
    return single.select(*[F.col(c) if c in own else F.date_from_unix_date("_t").alias(c) for c in columns], total.alias(out))
