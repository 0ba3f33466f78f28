"""Column profiles measured on table data.

All columns of a table are profiled together, in one scan for what merges and one for the ranks of quantiles. The first one is
wide: rows are not turned into (column, value) pairs, and only the single result row is unpivoted. Every
statistic has a partial state that merges, so a table is reduced in two levels: map tasks combine into
``profile_fan_in`` states per column, and one small task merges those. Without the first level, one
reducer would read a distinct-count sketch from every map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgauge.functions import classify
from fitgauge.functions.names import TABLE_KEYS
from fitgauge.operators.quantiles import Target, key, narrowed, over, quantile_map, quantile_sql
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.folders import work_dir
from fitgauge.sources.tables import choose_sample_size, sample_order, sample_rows

QUANTILES = (0.5, 0.95)
LENGTH_FIELDS = [f"{x}_length" for x in ("min", "max", "avg", "median", "p95", "stddev")]
VALUE_FIELDS = [f"{x}_value" for x in ("min", "max", "avg", "median", "p95", "stddev")]


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "semi_structured"
    return "other"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text(name: str, kind: str) -> str:
    """The column as text, in SQL: nested values as JSON, other types by cast."""
    col = quoted(name)
    return f"to_json({col})" if kind == "semi_structured" else f"cast({col} as string)"


@dataclass(frozen=True)
class Measure:
    """One column and the number measured on it: its value, or the length of its text.

    Expressions are SQL text. A wide table needs thousands of them, and text is parsed inside Spark
    while each Column operation is a call from Python to the JVM.
    """

    name: str
    kind: str
    tag: str
    min_words_length: int = DEFAULTS.content_min_length

    @property
    def is_longer(self) -> str:
        """Whether a text is long enough for its spaces to tell words from codes."""
        return f"length({quoted(self.name)}) > {self.min_words_length}" if self.kind == "text" else "false"

    @property
    def value(self) -> str:
        if self.kind == "numeric":
            return f"cast({quoted(self.name)} as double)"
        return f"cast(length({as_text(self.name, self.kind)}) as double)"

    @property
    def sketch(self) -> str:
        """Distinct-count sketch over 64-bit hashes, so that every type can be counted."""
        col = quoted(self.name)
        comparable = as_text(self.name, self.kind) if self.kind == "semi_structured" else col
        return f"hll_sketch_agg(if({col} is null, null, xxhash64({comparable})), {{bits}})"

    def base(self) -> list[str]:
        """Statistics that merge by themselves."""
        t, v = self.tag, self.value
        return [
            f"count({quoted(self.name)}) as {t}_n",
            f"min({v}) as {t}_min",
            f"max({v}) as {t}_max",
            f"sum({v}) as {t}_sum",
            f"count_if({self.is_longer}) as {t}_longer",
            f"count_if({self.is_longer} and contains({as_text(self.name, 'text')}, ' ')) as {t}_spaced",
        ]

    def partial(self, bits: int | None) -> list[str]:
        """State of one part of a table."""
        seen = [] if bits is None else [f"{self.sketch.format(bits=bits)} as {self.tag}_seen"]
        return [*self.base(), f"var_pop({self.value}) as {self.tag}_var", *seen]

    def merge(self, bits: int | None) -> list[str]:
        """The whole table's statistics from its parts."""
        t = self.tag
        distinct = "cast(null as bigint)" if bits is None else f"hll_sketch_estimate(hll_union_agg({t}_seen))"
        return [
            f"coalesce(sum({t}_n), 0) as {t}_n",
            f"min({t}_min) as {t}_min",
            f"max({t}_max) as {t}_max",
            f"sum({t}_sum) as {t}_sum",
            f"sum({t}_longer) as {t}_longer",
            f"sum({t}_spaced) as {t}_spaced",
            f"{merged_deviation(t)} as {t}_dev",
            f"{distinct} as {t}_distinct",
        ]

    @property
    def target(self) -> Target:
        return Target(self.tag, self.value, QUANTILES)

    def quantile(self, q: float) -> str:
        return f"found['{key(self.tag, q)}']"

    def result(self) -> str:
        """The column's row of the result, as a struct."""
        t = self.tag
        ranked = [self.quantile(q) for q in QUANTILES]
        stats = [f"{t}_min", f"{t}_max", f"if({t}_n > 0, {t}_sum / {t}_n, null)", *ranked, f"{t}_dev"]
        numeric = self.kind == "numeric"
        label = self.name.replace("\\", "\\\\").replace("'", "\\'")
        fields = [
            f"'{label}' as column_name",
            f"'{self.kind}' as kind",
            "total_rows",
            f"{t}_n as non_null_count",
            f"if(total_rows > 0, round((1 - {t}_n / total_rows) * 100, 2), 100D) as null_percentage",
            f"cast({t}_distinct as bigint) as approx_distinct",
            f"if({t}_longer > 0, {t}_spaced / {t}_longer, null) as spaced_share",
        ]
        for name, stat in zip(LENGTH_FIELDS, stats):
            whole = name in ("min_length", "max_length")
            shown = "null" if numeric else stat if whole else f"round({stat}, 2)"
            fields.append(f"cast({shown} as {'bigint' if whole else 'double'}) as {name}")
        for name, stat in zip(VALUE_FIELDS, stats):
            fields.append(f"cast({stat if numeric else 'null'} as double) as {name}")
        return f"struct({', '.join(fields)})"


def merged_deviation(tag: str) -> str:
    """Sample deviation of all parts, from each part's count, sum and variance."""
    n = f"{tag}_n"
    parts = (
        f"filter(collect_list(struct(cast({n} as double) as n, {tag}_sum / nullif({n}, 0) as mean, "
        f"{tag}_var * {n} as m2)), p -> p.n > 0)"
    )
    gap = "(b.mean - a.mean)"
    both = (
        f"struct(a.n + b.n as n, a.mean + {gap} * b.n / (a.n + b.n) as mean, "
        f"a.m2 + b.m2 + {gap} * {gap} * a.n * b.n / (a.n + b.n) as m2)"
    )
    zero = "struct(0D as n, 0D as mean, 0D as m2)"
    return f"aggregate({parts}, {zero}, (a, b) -> {both}, s -> if(s.n > 1, sqrt(s.m2 / (s.n - 1)), null))"


def profile_table(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    settings: Settings = DEFAULTS,
    *,
    distinct: bool = True,
    quantiles: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """One row of statistics per column; distinct counts and quantiles can be left out.

    One scan reduces all columns in two levels, another counts the ranks for the quantiles; very wide tables take these two for each
    ``columns_per_scan`` columns. Numbers of tables with over ``rank_values`` rows are narrowed before, a few scans in all,
    which run when this is called. Pass ``rows`` when the count is known; otherwise it is read from the file footers.
    """
    names = list(columns or df.columns)
    if quantiles and rows is None:
        rows = df.count()
    size = settings.columns_per_scan
    parts = [_profiled(df, names[i : i + size], settings, distinct, quantiles, rows) for i in range(0, len(names), size)]
    return reduce(DataFrame.unionByName, parts)


def _profiled(
    df: DataFrame, names: Sequence[str], settings: Settings, distinct: bool, quantiles: bool, rows: int | None
) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = [Measure(n, column_kind(types[n]), f"c{i}", settings.content_min_length) for i, n in enumerate(names)]
    df = df.select(*[quoted(n) for n in names])
    bits = settings.sketch_bits if distinct else None
    partial = ["count(*) as part_rows", *[x for m in measures for x in m.partial(bits)]]
    merge = ["coalesce(sum(part_rows), 0) as total_rows", *[x for m in measures for x in m.merge(bits)]]
    targets = [m.target for m in measures]
    if quantiles and rows > settings.rank_values:
        # texts have few different lengths, so these are counted as they are
        numbers = narrowed(df, [m.target for m in measures if m.kind == "numeric"], settings)
        targets = [m.target for m in measures if m.kind != "numeric"] + numbers
    results = ", ".join(m.result() for m in measures)

    def text(table: str) -> str:
        found = f"({quantile_sql(targets, table)})" if quantiles else "cast(null as map<string, double>)"
        parts = f"select {', '.join(partial)} from {table} group by pmod(spark_partition_id(), {settings.profile_fan_in})"
        return f"select inline(array({results})) from (select *, {found} as found from (select {', '.join(merge)} from ({parts})))"

    return over(df, text)


def quantile_bounds(df: DataFrame, margin: float = 0.02, settings: Settings = DEFAULTS) -> DataFrame:
    """Exact values a little below and above the median and the 95th percentile of every column, to judge estimates by."""
    around = [min(max(q + sign * margin, 0.0), 1.0) for q in QUANTILES for sign in (-1, 1)]
    measures = [Measure(f.name, column_kind(f.dataType), f"c{i}") for i, f in enumerate(df.schema.fields)]
    targets = [Target(m.tag, m.value, tuple(around)) for m in measures]
    found = quantile_map(df, narrowed(df, targets, settings) if df.count() > settings.rank_values else targets)
    fields = ("median_low", "median_high", "p95_low", "p95_high")
    rows = [
        F.struct(F.lit(m.name).alias("column_name"), *(F.expr(f"found['{key(m.tag, q)}']").alias(f) for q, f in zip(around, fields))) for m in measures]
    return found.select(F.inline(F.array(*rows)))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS, *, rows: int | None = None
) -> DataFrame:
    return profile_table(df, columns, settings, distinct=False, rows=rows).select(
        "column_name", "total_rows", "non_null_count", "null_percentage", *VALUE_FIELDS
    )


def text_profile(
    df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS, *, rows: int | None = None
) -> DataFrame:
    return profile_table(df, columns, settings, distinct=False, rows=rows).select(
        "column_name", "total_rows", "non_null_count", "null_percentage", *LENGTH_FIELDS
    )


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``counts``, the exact distinct count of each column by its place; columns without values have none.

    One scan: each row gives a pair of place and 128-bit hash for every column, repeated pairs go where they are read, and what is left
    is shuffled once, 20 bytes for a distinct value, whatever its length.
    """
    entries = []
    for i, name in enumerate(columns):
        value = as_text(name, "semi_structured") if column_kind(df.schema[name].dataType) == "semi_structured" else quoted(name)
        entries.append(f"if({quoted(name)} is null, null, struct({i} as place, xxhash64({value}) as a, xxhash64({i}, 'other seed', {value}) as b))")
    pairs = df.select(F.expr(f"explode(array({', '.join(entries)}))").alias("pair")).where("pair is not null")
    counts = pairs.select("pair.*").distinct().groupBy("place").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("counts"))


def exact_distinct(df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Exact distinct counts, from one scan for each ``columns_per_scan`` columns."""

    def some(names: Sequence[str]) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("column_name")) for i, n in enumerate(names)))
        listed = _distinct_counts(df, names).select("counts", F.inline(rows))
        return listed.select("column_name", F.coalesce(F.col("counts")[F.col("place")], F.lit(0)).alias("distinct_count"))

    size = settings.columns_per_scan
    return reduce(DataFrame.unionByName, [some(columns[i : i + size]) for i in range(0, len(columns), size)])


def sparsity_cardinality(
    df: DataFrame,
    columns: Sequence[str],
    settings: Settings = DEFAULTS,
    *,
    exact: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Null share and distinct share with their classes; lengths for text only."""
    base = profile_table(df, columns, settings, distinct=not exact, quantiles=False, rows=rows)
    if exact:
        base = base.join(exact_distinct(df, list(columns), settings), "column_name")
    else:
        base = base.withColumn("distinct_count", F.col("approx_distinct"))
    return base.selectExpr(
        "*",
        "if(total_rows > 0, (total_rows - non_null_count) / total_rows * 100, 100D) as nulls",
        "if(non_null_count > 0, distinct_count / non_null_count, 0D) as ratio",
        "kind in ('text', 'semi_structured') as has_length",
    ).select(
        "column_name",
        "kind",
        "total_rows",
        "non_null_count",
        F.round("nulls", 2).alias("null_percentage"),
        classify.sparsity_class(F.col("nulls"), settings).alias("sparsity"),
        "distinct_count",
        F.round("ratio", 4).alias("unique_ratio"),
        classify.cardinality_class(F.col("ratio"), settings).alias("cardinality"),
        F.when(F.col("has_length"), F.col("avg_length")).alias("avg_length"),
        F.when(F.col("has_length"), F.col("max_length")).alias("max_length"),
    )


def content_profile(
    df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS, *, rows: int | None = None
) -> DataFrame:
    """Length class of text columns."""
    lengths = profile_table(df, columns, settings, distinct=False, quantiles=False, rows=rows).filter("kind = 'text'")
    average = F.col("avg_length")
    return lengths.select(
        "column_name",
        average,
        "max_length",
        classify.content_class(average, settings).alias("content_class"),
        classify.content_is_natural(average, settings).alias("is_natural_language"),
        classify.content_is_structured(average, settings).alias("is_structured"),
    )


def json_type(parsed: Column) -> Column:
    """Type name of a parsed JSON value; null when the text was not JSON."""
    schema = F.schema_of_variant(parsed)
    # JSON type names.
    return (
        F.when(schema.startswith("OBJECT<"), "OBJECT")
        .when(schema.startswith("ARRAY<"), "ARRAY")
        .when(schema == "STRING", "VARCHAR")
        .when(schema == "BOOLEAN", "BOOLEAN")
        .when(schema == "VOID", "NULL_VALUE")
        .when(schema == "BIGINT", "INTEGER")
        .when(schema.startswith("DECIMAL"), "DECIMAL")
        .otherwise(schema)
    )


def json_profile(
    df: DataFrame, column: str, key: Sequence[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Share of valid JSON, objects and arrays, on a sample by ``key`` or on the whole column."""
    rows = df.select(*dict.fromkeys([*(key or []), column]))
    if key is not None:
        rows = sample_rows(rows, settings.json_sample, key)
    kinds = rows.filter(F.col(column).isNotNull()).select(
        json_type(F.try_parse_json(column)).alias("json_kind")
    )
    total = F.count("*")

    def rate(hits: Column) -> Column:
        return F.when(total > 0, F.round(hits / total * 100, 2)).otherwise(0.0)

    valid = F.count("json_kind")
    return kinds.agg(
        total.alias("sampled_values"),
        rate(valid).alias("valid_json_rate"),
        rate(F.count_if(F.col("json_kind") == "OBJECT")).alias("object_rate"),
        rate(F.count_if(F.col("json_kind") == "ARRAY")).alias("array_rate"),
        F.when(total > 0, valid / total >= 0.9).otherwise(False).alias("is_valid_structure"),
    ).select(F.lit(column).alias("column_name"), "*")


def content_sample(df: DataFrame, column: str, key: Sequence[str], settings: Settings = DEFAULTS) -> DataFrame:
    """A few longer values out of a small sample."""
    sample = sample_rows(df.select(*dict.fromkeys([*key, column])), settings.content_sample, key)
    longer = sample.filter(F.length(column) > settings.content_min_length)
    return longer.orderBy(*sample_order(key)).limit(settings.content_values)


def natural_language(
    df: DataFrame, column: str, key: Sequence[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Length class, corrected by whether values contain spaces when they are long enough to tell.

    With ``key`` a few sampled values are looked at, without it every value longer than the minimum.
    """
    if key is None:
        values = df.select(column).filter(F.length(column) > settings.content_min_length)
    else:
        values = content_sample(df, column, key, settings)
    spaced = values.agg(
        F.struct(
            F.count("*").alias("checked"), F.avg(F.col(column).contains(" ").cast("double")).alias("share")
        ).alias("spaced")
    )
    long_enough = (F.col("avg_length") >= settings.meaningful_length) & (F.col("checked_values") > 0)
    return (
        content_profile(df, [column], settings)
        .withColumn("spaced", spaced.scalar())
        .withColumn("checked_values", F.col("spaced.checked"))
        .withColumn("sample_with_spaces_rate", F.when(long_enough, F.round(F.col("spaced.share") * 100, 2)))
        .withColumn(
            "is_natural_language",
            F.when(long_enough, F.col("spaced.share") >= 0.5).otherwise(F.col("is_natural_language")),
        )
        .drop("spaced")
    )


def sampled_text_profile(
    targets: Mapping[tuple[str, str, str], tuple[DataFrame, str, Sequence[str] | None]], settings: Settings = DEFAULTS
) -> DataFrame:
    """Length statistics of one column per table, on a sample of each; ``text_profile_tables`` limits the tables.

    ``targets`` maps (database, schema, table) to its data, the column and a unique key; without a key, every row counts.
    """
    listed = sorted(targets.items())[: settings.text_profile_tables]

    def one(names: tuple[str, str, str], df: DataFrame, column: str, key: Sequence[str] | None) -> DataFrame:
        sample = df.select(*dict.fromkeys([*(key or []), column]))
        if key is not None:
            sample = sample_rows(sample, settings.text_profile_sample, key)
        length = F.length(column)
        return sample.agg(
            F.count("*").alias("total_rows_sampled"),
            F.count(column).alias("non_null_count"),
            F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"),
            F.max(length).alias("max_length"),
            F.min(length).alias("min_length"),
        ).select(
            *[F.lit(n).alias(k) for k, n in zip(TABLE_KEYS, names)],
            F.lit(column).alias("column_name"),
            "*",
        )

    return reduce(DataFrame.unionByName, [one(names, *target) for names, target in listed])


def json_top_keys(
    df: DataFrame, column: str, key: Sequence[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Distinct top-level keys, of a sample by ``key`` or of the whole column."""
    rows = df.select(*dict.fromkeys([*(key or []), column]))
    if key is not None:
        rows = sample_rows(rows, settings.json_key_sample, key)
    keys = rows.select(F.explode(F.json_object_keys(column)).alias("json_key")).distinct()
    if settings.json_key_limit is not None:
        keys = keys.orderBy("json_key").limit(settings.json_key_limit)
    return keys.select(F.lit(column).alias("column_name"), "json_key")


def json_key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Top-level keys of the objects in several JSON columns, and in how many values each stands; one scan for all columns."""
    entries = [f"transform(json_object_keys({quoted(c)}), k -> struct({i} as place, k as json_key))" for i, c in enumerate(columns)]
    listed = ", ".join(f"coalesce({e}, array())" for e in entries)
    found = df.select(F.expr(f"explode(concat({listed}))").alias("e")).select("e.*")
    counted = found.groupBy("place", "json_key").agg(F.count("*").alias("n"))
    name = F.array(*map(F.lit, columns))[F.col("place")]
    return counted.select(name.alias("column_name"), "json_key", "n")


def _children(path: str, value: str) -> str:
    """Members of an object and elements of an array, each with its path, in SQL."""
    joined = f"if({path} = '', {{0}}, concat({path}, '.', {{0}}))"
    members = f"map_entries(try_variant_get({value}, '$', 'map<string,variant>'))"
    elements = f"try_variant_get({value}, '$', 'array<variant>')"
    return (
        f"concat(coalesce(transform({members}, m -> struct({joined.format('m.key')} as path, m.value as value)), array()), "
        f"coalesce(transform({elements}, x -> struct({joined.format(repr('[]'))} as path, x as value)), array()))"
    )


CONTAINERS = ("OBJECT", "ARRAY")


def json_path_types(df: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """Paths and types inside a JSON column, with their counts, down to the deepest level or to ``depth``.

    The column is read and parsed once, which stores its objects and arrays. Each level is made from the stored objects and arrays of the
    one above, and only where there are any, so that a few deep values cost no more than themselves. A level is
    counted by a partial aggregate; its objects and arrays are written without a shuffle.
    """
    work = work_dir(df.sparkSession)

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(rows.schema).parquet(f"{work}/{name}")

    roots = df.select(F.lit("").alias("path"), F.try_parse_json(column).alias("value"))
    level = stored(roots.where(json_type(F.col("value")).isin(*CONTAINERS)), "level0")
    counts, n = [], 0
    while True:
        found = level.select(F.expr(f"inline({_children('path', 'value')})")).withColumn("type", json_type(F.col("value")))
        counts.append(stored(found.groupBy("path", "type").agg(F.count("*").alias("n")), f"counts{n}"))
        n += 1
        if n == depth or counts[-1].where(F.col("type").isin(*CONTAINERS)).isEmpty():
            break
        level = stored(found.where(F.col("type").isin(*CONTAINERS)).select("path", "value"), f"level{n}")
    every = reduce(DataFrame.unionByName, counts).groupBy("path", "type").agg(F.sum("n").alias("n"))
    return every.orderBy(F.col("n").desc(), "path", "type")


def json_extract_text(df: DataFrame, column: str, path: str, keep: Sequence[str], name: str) -> DataFrame:
    """The text at a path, for the rows that have it."""
    value = F.try_variant_get(F.try_parse_json(column), path, "string")
    return df.select(*keep, value.alias(name)).filter(F.col(name).isNotNull())


def adaptive_sample(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    rows: int,
    total_bytes: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Profile of a sample whose size is picked, before reading, from the table's known size."""
    size = choose_sample_size(rows, total_bytes, settings)
    sample = sample_rows(df.select(*dict.fromkeys([*key, *columns])), size, key)
    profiled = profile_table(sample, columns, settings, distinct=False, rows=min(rows, size))
    return profiled.withColumn("sample_size", F.lit(size))
