"""Exact interpolated quantiles of many columns, found by counting ranks.

Every row gives one pair (target, value) for each column; equal pairs are counted where they are read and summed in one shuffle, and
running sums over the sorted values of a column show at which value a rank lies. That last step sorts the distinct values of a column in
one task, so a column that may have more than ``rank_values`` of them is narrowed before: rows are counted in bins between its
ends, the bin that holds the rank becomes the new range, and so on until few rows or one value are left. A bin is a function of the
value that never decreases, hence counts in bins are ranks, whatever the distribution is; the ends of a range lie in
different bins, hence every round narrows it. Only counts and ends come to the driver. No setting changes a result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgauge.settings import DEFAULTS, Settings

#: Bins of one round; those of values that are no finite numbers lie behind all others.
BINS = 4096
OUTSIDE = 8 * BINS
#: Quarters of octaves, on either side of the bin of zero; no double is smaller than 2 ** -OCTAVES.
OCTAVES, ZERO = 1100, 2 * BINS + 2000
#: Every third round counts by sign and order of magnitude, so that long-tailed values end as soon as even ones: it leaves a range whose ends
#: differ by a fifth at most, and each of the others divides it by ``BINS``.
LOG_ROUND = 3


def literal(value: float) -> str:
    """A double in SQL, without loss and also for values that have no number form."""
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def two_level(df: DataFrame, partial: Sequence[str], merge: Sequence[str], settings: Settings) -> DataFrame:
    """One row of ``merge`` over the ``partial`` states of up to ``profile_fan_in`` parts of the rows.

    A global aggregation sends one state per map task to a single reducer; sketches of many columns from
    very many tasks would queue there. The first level spreads them over reducers.
    """
    part = F.expr(f"pmod(spark_partition_id(), {settings.profile_fan_in})").alias("part")
    return df.groupBy(part).agg(*map(F.expr, partial)).agg(*map(F.expr, merge))


@dataclass(frozen=True)
class Target:
    """A column's values (``value`` is SQL), the quantiles wanted of them, and what is known of those.

    ``low`` to ``high`` is the range that holds the ranks. ``below`` rows lie under it, ``inside`` in it, ``total`` in all; rows outside
    are left out once they are counted. ``settled`` are the values at the ranks below and above a quantile, when they are known.
    """

    column: str
    value: str
    quantiles: tuple[float, ...]
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int | None = None
    total: int | None = None
    counted: bool = False
    settled: tuple[float, float] | None = None

    @property
    def place(self) -> float:
        return self.quantiles[0] * (self.total - 1)

    @property
    def in_range(self) -> str:
        """The value, null outside of the range."""
        if not self.counted:
            return self.value
        return f"if({self.value} between {literal(self.low)} and {literal(self.high)}, {self.value}, null)"

    def result(self) -> float:
        """The interpolated value of a settled quantile."""
        low, high = self.settled
        share = self.place - math.floor(self.place)
        return low if low == high or math.isnan(low) or not share else (1 - share) * low + share * high


def _doubles(values: Sequence[float]) -> str:
    """A range's own number, in SQL."""
    return f"array({', '.join(map(literal, values))})[t]"


def _bin(turn: int, low: str, width: str) -> str:
    """The bin of ``v``, which is not null, in SQL; ``low`` and ``width`` are halves. Values that are no finite numbers have bins of their
    own at the ends."""
    inner = f"cast(floor((v * 0.5D - {low}) / {width} * {BINS}) as int)"
    if turn % LOG_ROUND == LOG_ROUND - 1:
        size = f"1 + cast(floor(({OCTAVES} + log2(abs(v))) * 4) as int)"
        inner = f"if(v = 0D, {ZERO}, if(v > 0D, {ZERO} + {size}, {ZERO} - ({size})))"
    return (
        f"case when isnan(v) then {OUTSIDE + 1} when v = double('infinity') then {OUTSIDE} "
        f"when v = double('-infinity') then -1 else {inner} end"
    )


def _running(counts: DataFrame, by: str) -> DataFrame:
    """Adds ``upto``, the rows of a target up to and with each group, and ``among``, all its rows."""
    target = Window.partitionBy("t")
    running = target.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"upto": F.sum("n").over(running), "among": F.sum("n").over(target)})


def _of(values: Sequence, kind: str, at: str) -> Column:
    """The own value of a target or a range, whose place is ``at``."""
    return F.array(*(F.lit(v).cast(kind) for v in values))[F.col(at)]


def _narrow(df: DataFrame, targets: Sequence[Target], turn: int) -> list[Target]:
    """One scan that counts each target's range in bins and keeps the bins that hold the ranks below and above its quantile.

    Targets with one range share its counts. What differs between ranges stands in arrays, so that the code for a row stays short however
    many columns there are: the JVM does not compile long methods.
    """
    ranges = list(dict.fromkeys((x.value, x.low, x.high, x.counted) for x in targets))
    entries = ", ".join(f"struct({i} as t, {value} as v)" for i, (value, *_) in enumerate(ranges))
    pairs = df.select(F.expr(f"explode(array({entries}))").alias("pair")).select("pair.*").where("v is not null")
    low, high = ([x[i] for x in ranges] for i in (1, 2))
    if all(counted for *_, counted in ranges):
        pairs = pairs.where(f"v between {_doubles(low)} and {_doubles(high)}")
    bins = _bin(turn, _doubles([a * 0.5 for a in low]), _doubles([b * 0.5 - a * 0.5 for a, b in zip(low, high)]))
    pairs = pairs.select("t", F.expr(bins).alias("bin"), "v")
    counts = _running(pairs.groupBy("t", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "bin")
    asking = [[str(i) for i, x in enumerate(targets) if (x.value, x.low, x.high, x.counted) == r] for r in ranges]
    asked = counts.withColumn("x", F.explode(F.expr(f"array({', '.join(f'array({", ".join(a)})' for a in asking)})[t]")))
    first, last = (_of([f(x.place) - x.below for x in targets], "bigint", "x") for f in (math.floor, math.ceil))
    before = F.col("upto") - F.col("n")
    held = asked.where((F.col("upto") > first) & (before <= last))
    # two neighbouring ranks lie in one bin, or in two with nothing in between
    rows = held.groupBy("x").agg(
        F.count("*").alias("bins"), F.sum("n").alias("n"), F.min(before).alias("before"), F.min(F.struct("bin", "low", "high")).alias("lower"),
        F.max(F.struct("bin", "low", "high")).alias("upper"))
    out = list(targets)
    for r in rows.collect():
        x = replace(targets[r.x], low=r.lower.low, high=r.upper.high, below=targets[r.x].below + r.before, inside=r.n, counted=True)
        if r.bins == 2:
            x = replace(x, settled=(r.lower.high, r.upper.low))
        elif x.low == x.high or math.isnan(x.low):
            x = replace(x, settled=(x.low, x.low))
        out[r.x] = x
    return out


def narrowed(df: DataFrame, targets: Sequence[Target], settings: Settings = DEFAULTS) -> list[Target]:
    """The targets with ranges of at most ``rank_values`` rows, or settled; each quantile of a narrowed column is a target of its own.

    One scan finds the ends of all columns, each further one counts in bins: a few, whatever the number of rows.
    """
    if not targets:
        return []
    finite = [f"if(abs({x.value}) < double('infinity'), {x.value}, null)" for x in targets]
    ends = [e for t, x in enumerate(targets) for e in (f"count({x.value}) as n{t}", f"min({finite[t]}) as low{t}", f"max({finite[t]}) as high{t}")]
    merge = [e for t in range(len(targets)) for e in (f"sum(n{t}) as n{t}", f"min(low{t}) as low{t}", f"max(high{t}) as high{t}")]
    whole = two_level(df, ends, merge, settings).first()
    done, wide = [], []
    for t, x in enumerate(targets):
        n, low, high = whole[f"n{t}"], whole[f"low{t}"], whole[f"high{t}"]
        if not n or n <= settings.rank_values or low is None or not _splits(low, high):
            done.append(x)  # few rows, or few values
        else:
            wide += [replace(x, quantiles=(q,), low=low, high=high, total=n) for q in x.quantiles]
    turn = 0
    while wide:
        found = _narrow(df, wide, turn)
        turn += 1
        wide = [x for x in found if x.settled is None and x.inside > settings.rank_values and _splits(x.low, x.high)]
        done += [x for x in found if x not in wide]
    return done


def _splits(low: float, high: float) -> bool:
    """Whether a range can be divided: its halves differ. Other ranges hold two neighbouring doubles at most."""
    return high * 0.5 - low * 0.5 > 0


def key(column: str, quantile: float) -> str:
    return f"{column}@{quantile!r}"


def over(df: DataFrame, text: Callable[[str], str]) -> DataFrame:
    """A statement over a DataFrame, given the name to read it by. One text is analyzed once, where a chain of calls is analyzed anew with
    each of them, which for many columns takes longer than small tables do."""
    name = f"fitgauge_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(text(name))
    finally:
        df.sparkSession.catalog.dropTempView(name)


def _list(values: Sequence, kind: str) -> str:
    """A target's own value, in SQL."""
    shown = ", ".join("null" if v is None else f"'{_escaped(v)}'" if isinstance(v, str) else str(v).lower() for v in values)
    return f"cast(array({shown}) as array<{kind}>)[t]"


def quantile_sql(targets: Sequence[Target], rows: str) -> str:
    """A query with one row and one column, a map from ``key(column, quantile)`` to the exact value; columns without values have no entry.

    One scan of the columns that are not settled, and one shuffle of the distinct values in their ranges.
    """
    known = {key(x.column, x.quantiles[0]): x.result() for x in targets if x.settled is not None}
    fixed = ", ".join(f"struct('{_escaped(k)}' as key, {literal(v)} as value)" for k, v in known.items())
    fixed = f"array({fixed})" if known else "cast(array() as array<struct<key:string,value:double>>)"
    targets = [x for x in targets if x.settled is None]
    if not targets:
        return f"select map_from_entries({fixed}) as found"
    pairs = ", ".join(f"if({x.in_range} is null, null, struct({i} as t, {x.value} as v))" for i, x in enumerate(targets))
    entries = []
    for q in sorted({q for x in targets for q in x.quantiles}):
        place = f"({q!r}D * (total - 1))"
        low, high = (f"min(if(upto > {r} - below and upto - n <= {r} - below, v, null))" for r in (f"floor({place})", f"ceil({place})"))
        share = f"max({place} - floor({place}))"
        value = f"if({low} = {high} or {share} = 0, {low}, (1 - {share}) * {low} + {share} * {high})"
        name = f"concat({_list([x.column for x in targets], 'string')}, '{key('', q)}')"
        entries.append(f"if({_list([q in x.quantiles for x in targets], 'boolean')}, struct({name} as key, {value} as value), null)")
    return f"""
        select map_from_entries(concat(flatten(collect_list(entries)), {fixed})) as found from (
            select t, array_compact(array({", ".join(entries)})) as entries from (
                select *, coalesce({_list([x.total for x in targets], "bigint")}, among) as total, {_list([x.below for x in targets], "bigint")} as below from (
                    select *, sum(n) over (partition by t order by v rows between unbounded preceding and current row) as upto,
                        sum(n) over (partition by t) as among from (
                        select pair.t, pair.v, count(*) as n from (select explode(array({pairs})) as pair from {rows})
                        where pair is not null group by pair.t, pair.v)))
            group by t)"""


def quantile_map(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """One row with ``found``, the map of ``quantile_sql``."""
    return over(df, lambda rows: quantile_sql(targets, rows))


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")
