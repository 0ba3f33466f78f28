"""The same queries as SQL text, for an independent engine (DuckDB dialect)."""

from __future__ import annotations

from fitgauge import settings as st
from fitgauge.checks import fixtures
from fitgauge.checks.queries import ALL_TABLES, CUSTOM_PII, DATABASE, NUMBERS, SCHEMA, TEXTS, UNIQUE, UNIQUE_KEYS

K3 = "database_name, schema_name, table_name"
K4 = K3 + ", column_name"
K5 = K4 + ", feature"
COLUMNS = {
    "region": ["r_regionkey:n", "r_name"],
    "nation": ["n_nationkey:n", "n_name", "n_regionkey:n"],
    "customer": ["c_custkey:n", "c_name", "c_nationkey:n", "c_acctbal:n", "c_mktsegment"],
    "supplier": ["s_suppkey:n", "s_name", "s_nationkey:n", "s_acctbal:n"],
    "part": ["p_partkey:n", "p_name", "p_brand", "p_type", "p_size:n", "p_retailprice:n"],
    "orders": [
        "o_orderkey:n", "o_custkey:n", "o_orderstatus", "o_totalprice:n", "o_orderdate", "o_orderpriority",
    ],
    "lineitem": [
        "l_orderkey:n", "l_partkey:n", "l_suppkey:n", "l_linenumber:n", "l_quantity:n",
        "l_extendedprice:n", "l_discount:n", "l_tax:n", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id:n", "ts", "user_id:n", "event_type", "value:n", "props"],
    "documents": ["doc_id:n", "text", "lang", "source", "n_chars:n"],
    "embeddings": ["vec_id:n", "label:n"],
    "pages": ["page_id:n", "url", "html"],
    "benchmark": ["item_id:n", "text"],
    "labels": ["doc_id:n", "quality:n", "toxic:n"],
    "conversations": ["conv_id:n", "turn:n", "role", "text"],
}


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding of the decimal form of a double."""
    return f"cast(round(cast(cast({expr} as varchar) as decimal(38, 12)), {digits}) as double)"


def settled(expr: str) -> str:
    return rnd(f"({expr} + 1e-7)", 5)


def words(col: str, parts: tuple[str, ...] | list[str]) -> str:
    return f"coalesce(regexp_matches(upper({col}), '{'|'.join(parts)}'), false)"


def like(col: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"coalesce(upper({col}) like '{x}', false)" for x in patterns) + ")"


def listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def share(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then {rnd(f'{part} / {whole} * 100', 1)} else 0.0::double end"


def first_row(source: str, keys: str, order: str, where: str = "true") -> str:
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by {keys} order by {order}) as rn "
        f"from {source} where {where}) where rn = 1"
    )


def present(col: str) -> str:
    return rf"coalesce(regexp_matches({col}, '\S'), false)"


BASE = "trim(split_part(upper(coalesce(data_type, '')), '(', 1))"
FAMILY = f"""case when {BASE} in ({listed(st.UNSUPPORTED_TYPES)}) then 'unsupported'
  when {BASE} in ({listed(st.SEMI_STRUCTURED_TYPES)}) then 'semi_structured'
  when {BASE} in ({listed(st.TEXT_TYPES)}) then 'text'
  when {BASE} in ({listed(st.NUMERIC_TYPES)}) then 'numeric'
  when {BASE} in ({listed(st.TEMPORAL_TYPES)}) then 'temporal' else 'other' end"""
LONG = "coalesce(character_maximum_length >= {}, false)"


def null_points(col: str) -> str:
    return (
        f"case when {col} <= 10 then 2.0::double when {col} <= 30 then 1.5 when {col} <= 50 then 1.0 "
        f"when {col} <= 70 then 0.5 else 0.0 end"
    )


def length_points(col: str) -> str:
    return (
        f"case when {col} >= 200 then 2.0::double when {col} >= 100 then 1.5 when {col} >= 50 then 1.0 "
        f"when {col} > 0 then 0.5 else 0.0 end"
    )


GUESS = f"""case when character_maximum_length > 0
  then {rnd("least(character_maximum_length * 0.3::double, 5000.0::double)", 2)} else 100.0::double end"""
MEASURED = f"""{null_points("coalesce(null_percentage, 100.0)")} + {length_points("avg_length")}
  + case when longest / max_length * 100 > 50 and max_length > 0 then 1.0::double
    when longest / max_length * 100 >= 25 and max_length > 0 then 0.5 else 0.0 end"""

CTES: dict[str, str] = {name: fixtures.oracle_text(name) for name in fixtures.SQL}
CTES |= {
    "live_tables": "select * exclude (deleted) from ("
    + first_row("fx_tables", K3, "created desc, last_altered desc nulls last", "deleted is null") + ")",
    "live_columns": "select * exclude (deleted) from ("
    + first_row("fx_columns", K4, "ordinal_position, data_type", "deleted is null") + ")",
    "live_constraints": f"select {K3}, constraint_type, constraint_name from ("
    + first_row("fx_constraints", K3 + ", constraint_name", "constraint_type", "deleted is null") + ")",
    "live_storage": first_row("fx_storage", K3, "active_bytes desc nulls last", "database_name is not null"),
    "live_stages": "select * exclude (deleted) from ("
    + first_row("fx_stages", "database_name, schema_name, stage_name", "created desc", "deleted is null") + ")",
    "llm": f"""
select {K4}, 'llm' as feature, data_type, character_maximum_length as max_length, column_comment as comment,
  'Text column (' || data_type || ') - ' || case when {LONG.format(500)} then 'long text' else 'semantic name' end
    as reason
from live_columns where {words("data_type", st.TEXT_TYPE_PARTS)}
  and ({LONG.format(500)} or {words("column_name", st.TEXT_WORDS)})""",
    "extract": f"""
select {K4}, 'extract' as feature, data_type, column_comment as comment,
  'Semi-structured ' || data_type || ' column' as reason
from live_columns where upper(data_type) in ({listed(st.SEMI_STRUCTURED_TYPES)})""",
    "forecast": f"""
select {K3}, 'forecast' as feature, 'Has timestamp + ' || numbers || ' numeric columns' as reason,
  names[1:5] as numeric_columns
from (select {K3}, bool_or({words("data_type", st.TIME_TYPE_PARTS)}) as has_time, count(*) filter (number) as numbers,
    list(column_name order by ordinal_position, column_name) filter (number) as names
  from (select *, {words("data_type", st.FORECAST_NUMERIC_PARTS)} as number from live_columns) group by {K3})
where has_time and numbers >= 1""",
    "search": f"""
select {K3}, 'search' as feature, texts || ' substantial text columns' as reason, names[1:5] as text_columns
from (select {K3}, count(*) as texts, list(column_name order by ordinal_position, column_name) as names
  from live_columns where {words("data_type", st.SEARCH_TYPE_PARTS)} and {LONG.format(200)} group by {K3})
where texts >= 2""",
    "candidates": """
select * from llm union all by name select * from extract
union all by name select * from forecast union all by name select * from search""",
    "rich": f"""
select {K4}, ordinal_position, data_type, character_maximum_length, column_comment from live_columns
where data_type in ({listed(st.RICH_TEXT_TYPES)})
  and ({LONG.format(1000)} or {words("column_name", st.RICH_TEXT_WORDS)})""",
    "rich_tables": f"""
select {K3}, 'search' as feature, texts || ' text columns' as reason, names[1:10] as text_columns
from (select {K3}, count(*) as texts, list(column_name order by ordinal_position, column_name) as names
  from rich group by {K3}) where texts >= 2""",
    "domain": f"select distinct {K3} from live_columns where {words('table_name', st.DOMAIN_WORDS)}",
    "documents_like": f"select {K4}, data_type from live_columns where {like('column_name', st.DOCUMENT_PATTERNS)}",
    "pii": f"select {K4}, data_type from live_columns where {like('column_name', st.PII_PATTERNS)}",
    "pii_named": "select *, case "
    + " ".join(
        f"when {words('database_name || schema_name || table_name || column_name || data_type', w)} then '{n}'"
        for n, w in st.PII_CATEGORIES
    )
    + " else 'Other' end as category from pii",
    "stats": f"""
select {K4}, upper(coalesce(data_type, '')) as data_type, coalesce(t.row_count, 0) as row_count,
  case when is_nullable = 'NO' then coalesce(t.row_count, 0)
    else cast(floor(coalesce(t.row_count, 0) * 0.8::double) as bigint) end as non_null_count,
  case when is_nullable = 'NO' then 0.0::double else 20.0::double end as null_percentage,
  case when is_text then 0::bigint end as min_length,
  case when is_text then case when character_maximum_length > 0 then character_maximum_length else 16777216 end end
    as max_length,
  case when is_text then {GUESS} end as avg_length,
  not is_text and not is_number and {BASE} in ({listed(st.SEMI_STRUCTURED_TYPES)}) as is_semi_structured,
  is_nullable, {present("column_comment")} as has_comment
from (select *, {BASE} in ({listed(st.TEXT_TYPES)}) or {words(BASE, st.TEXT_TYPE_PARTS)} as is_text,
    {BASE} in ({listed(st.NUMERIC_TYPES)}) or {words(BASE, st.NUMERIC_TYPE_PARTS)} as is_number from live_columns) c
  left join (select {K3}, row_count from live_tables) t using ({K3})""",
    "with_stats": f"""
select {K5}, c.comment, c.table_name as t, s.row_count, s.non_null_count, s.null_percentage, s.avg_length,
  s.max_length as estimated_max_length, s.is_nullable, s.has_comment,
  case when s.null_percentage is not null then 'metadata_only' end as source
from candidates c left join (select * exclude (data_type) from stats) s using ({K4})""",
    "profiled": f"""
select c.*, p.total_rows_sampled, p.non_null_count, p.null_percentage, p.avg_length, p.max_length as longest,
  p.is_natural_language, p.is_valid_structure, p.col_id is not null as has_profile
from candidates c left join fx_profiles p using ({K4})""",
    "first_scored": f"""
select *, case feature when 'forecast' then 5.0::double when 'llm' then 4 when 'search' then 4 else 3 end
    as business_potential,
  case when non_null_count > 0 and total_rows_sampled > 0 and non_null_count / total_rows_sampled > 0.9
    then 5.0::double when avg_length > 100 then 4 else 3 end as first_readiness,
  case when comment <> '' then 4.0::double else 2 end as metadata_quality,
  case when {words("column_name", st.RISK_WORDS)} or {words("table_name", st.RISK_WORDS)} then 5.0::double else 2 end
    as governance_risk
from profiled""",
    "rescored": f"""
select *, business_potential + data_readiness + metadata_quality + governance_risk as total_score
from (select *, case when has_profile then {MEASURED} else first_readiness end as data_readiness
  from first_scored)""",
    "checked": """
select *, coalesce(null_percentage, 100.0) as nulls, nullif(avg_length, 0.0) as known_length,
  feature in ('llm', 'search') as reads_text from rescored""",
    "scored": """
select *, case when total_score >= 15 and governance_risk <= 3 then 'P1' when total_score >= 12 then 'P2'
  else 'P3' end as priority,
  nulls <= 50 and data_readiness >= 3.5
    and not (reads_text and (coalesce(known_length < 30, false) or coalesce(not is_natural_language, false)))
    and not (feature = 'extract' and coalesce(not is_valid_structure, false)) as is_confirmed
from checked""",
    "top": f"""
select * from scored where column_name is not null
order by total_score desc, {K4}, feature limit 200""",
    "column_summary": f"""
select {K3}, count(*) as total_columns, count(*) filter ({present("column_comment")}) as commented_columns,
  count(*) filter (family = 'unsupported') as unsupported_columns,
  count(*) filter (family = 'semi_structured') as semi_structured_columns
from (select *, {FAMILY} as family from live_columns) group by {K3}""",
    "constraint_summary": f"""
select {K3}, bool_or(upper(constraint_type) = 'PRIMARY KEY') as has_primary_key,
  bool_or(upper(constraint_type) = 'FOREIGN KEY') as has_foreign_key,
  bool_or(upper(constraint_type) = 'UNIQUE') as has_unique,
  list_sort(list_distinct(list(constraint_type))) as constraint_types
from live_constraints group by {K3}""",
    "inputs": f"""
select {K3}, table_type, row_count, bytes, table_comment, created, last_altered, clustering_key,
  coalesce(total_columns, 0) as total_columns, coalesce(commented_columns, 0) as commented_columns,
  coalesce(unsupported_columns, 0) as unsupported_columns,
  coalesce(semi_structured_columns, 0) as semi_structured_columns,
  has_primary_key, has_foreign_key, has_unique, constraint_types, active_bytes
from live_tables full join column_summary using ({K3}) left join constraint_summary using ({K3})
  left join (select {K3}, active_bytes from live_storage) using ({K3})""",
    "dimensions": f"""
select *,
  {rnd(f'''case when {present("table_comment")} then 40.0::double else 0.0 end
    + case when total_columns > 0 then commented_columns / total_columns * 60.0::double else 0.0 end''', 2)}
    as comments,
  case when total_columns > 0 then {rnd('''(total_columns - unsupported_columns - semi_structured_columns
    + semi_structured_columns * 0.5::double) / total_columns * 100''', 2)} else 0.0::double end as data_types,
  case when age is null then 0.0::double when age <= 7 then 100.0 when age <= 30 then 80.0
    when age <= 90 then 50.0 when age <= 180 then 25.0 else 10.0 end as freshness,
  case when has_key and is_large then 100.0::double when has_key then 70.0 when is_large then 10.0 else 0.0 end
    as clustering,
  case when has_primary_key then 50.0::double else 0.0 end + case when has_foreign_key then 30.0 else 0.0 end
    + case when has_unique then 20.0 else 0.0 end as constraints
from (select *, datesub('day', last_altered::timestamp, timestamp '2001-08-01') as age,
    {present("clustering_key")} as has_key, coalesce(active_bytes > 1073741824, false) as is_large from inputs)""",
    "readiness": f"""
select *, {rnd('''comments * 0.25::double + data_types * 0.2::double + freshness * 0.25::double
  + clustering * 0.15::double + constraints * 0.15::double''', 2)} as total_score from dimensions""",
    "stored": f"""
select {K5}, reason from candidates where feature in ('llm', 'extract') and upper(database_name) in ('DB_0', 'DB_3')""",
    "fresh": f"select {', '.join('c.' + k for k in K5.split(', '))}, c.reason from candidates c anti join stored s on "
    + " and ".join(f"coalesce(s.{k}, '') = coalesce(c.{k}, '')" for k in K5.split(", ")),
}

DIMS = "comments, data_types, freshness, clustering, constraints"
SCORES = "business_potential, data_readiness, metadata_quality, governance_risk"
SCORED = f"{K5}, {SCORES}, total_score"
BY_SCORE = f"total_score desc, {K3}"
BY_CANDIDATE = ", ".join(
    f"{k} nulls first" for k in ("database_name", "schema_name", "table_name", "column_name", "feature")
)


def needed(text: str) -> list[str]:
    """Shared definitions a statement uses, in the order they were written."""
    import re

    todo, seen = [text], set()
    while todo:
        used = set(re.findall(r"\w+", todo.pop())) & CTES.keys()
        todo += [CTES[u] for u in used - seen]
        seen |= used
    return [name for name in CTES if name in seen]


def statement(select: str) -> str:
    names = needed(select)
    once = "materialized " if select in ONCE else ""
    head = ",\n".join(f"{n} as {once}({CTES[n]})" for n in names)
    return f"with {head}\n{select}" if names else select


def top(cols: str, source: str, order: str, n: int) -> str:
    return (
        f"select row_number() over (order by {order})::int as rank, {cols} from "
        f"(select * from {source} order by {order} limit {n})"
    )


def name(width: int | None = None, keys: str = K4) -> str:
    full = f"concat_ws('.', {keys})"
    return full if width is None else f"substring({full}, 1, {width})"


def md5_order(keys: list[str]) -> str:
    joined = " || '|' || ".join(f"cast({k} as varchar)" for k in keys)
    return f"md5({joined}), " + ", ".join(keys)


def number_stats(v: str) -> str:
    v = f"cast({v} as double)"
    exprs = [f"min({v})", f"max({v})", f"avg({v})", f"quantile_cont({v}, 0.5)", f"quantile_cont({v}, 0.95)", f"stddev_samp({v})"]
    names = ("min", "max", "avg", "median", "p95", "stddev")
    return ", ".join(f"{settled(x)} as {n}_value" for x, n in zip(exprs, names))


def length_stats(col: str) -> str:
    v = f"length(cast({col} as varchar))"
    return (
        f"min({v})::bigint as min_length, max({v})::bigint as max_length, {rnd(f'avg({v})', 2)} as avg_length, "
        f"{rnd(f'quantile_cont({v}::double, 0.5)', 2)} as median_length, "
        f"{rnd(f'quantile_cont({v}::double, 0.95)', 2)} as p95_length, {rnd(f'stddev_samp({v})', 2)} as stddev_length"
    )


NO_NUMBERS = ", ".join(f"null::double as {n}_value" for n in ("min", "max", "avg", "median", "p95", "stddev"))
NO_LENGTHS = "null::bigint as min_length, null::bigint as max_length, " + ", ".join(
    f"null::double as {n}_length" for n in ("avg", "median", "p95", "stddev")
)


def counts(col: str) -> str:
    return (
        f"'{col}' as column_name, count(*) as total_rows, count({col}) as non_null_count, "
        f"{rnd(f'(1 - count({col}) / count(*)) * 100', 2)} as null_percentage"
    )


def per_column(tables: dict[str, list[str]], select) -> str:
    return "\nunion all ".join(
        f"select '{t}' as table_name, {select(c)} from {t}" for t, cols in tables.items() for c in cols
    )


def spaced(col: str) -> str:
    """Share of longer texts that contain a space; none for dates."""
    if col in ("o_orderdate", "l_shipdate", "ts"):
        return "null::double"
    return settled(f"avg(case when contains({col}, ' ') then 1.0::double else 0.0 end) filter (length({col}) > 20)")


def movers(source: str) -> str:
    """Candidates that rose and fell most; ``source`` has ``scored`` and ``before``."""
    moved = f"(select *, data_readiness - before as change, coalesce(avg_length, 0.0) as avg0 from ({source}) where has_profile)"
    up = top(
        f"""'up' as direction, {name(55)} as name, before, data_readiness as after, change,
  case when nulls <= 10 and avg0 >= 200 then 'High quality + rich content' when nulls <= 10 then 'Excellent completeness'
    when avg0 >= 200 then 'Rich content' else 'Good data quality' end as reason""",
        f"(select * from {moved} where change > 0)", f"change desc, {BY_CANDIDATE}", 15,
    )
    down = top(
        f"""'down' as direction, {name(55)} as name, before, data_readiness as after, change,
  case when nulls > 70 then printf('High NULLs (%.1f%%)', nulls) when avg0 < 50 then printf('Short content (%.1f chars)', avg0)
    when nulls > 50 then printf('Many NULLs (%.1f%%)', nulls) else 'Data quality issues' end as reason""",
        f"(select * from {moved} where change < 0)", f"change, {BY_CANDIDATE}", 15,
    )
    return f"select * from ({up}) union all by name select * from ({down})"


def mean(col: str) -> str:
    return f"cast(sum(cast({col} as decimal(18, 6))) as double) / nullif(count({col}), 0)"


def kind_of(col: str) -> str:
    return "numeric" if ":" in col else "other" if col in ("o_orderdate", "l_shipdate", "ts") else "text"


def extremes(col: str) -> str:
    bare = col.split(":")[0]
    if ":" in col:
        v = f"cast({bare} as double)"
        return f"null::bigint as min_length, null::bigint as max_length, null::double as avg_length, {settled(f'min({v})')} as min_value, {settled(f'max({v})')} as max_value"
    v = f"length(cast({bare} as varchar))"
    return f"min({v})::bigint as min_length, max({v})::bigint as max_length, {rnd(f'avg({v})', 2)} as avg_length, null::double as min_value, null::double as max_value"


def profile_any(col: str) -> str:
    bare, _, number = col.partition(":")
    if number:
        return f"{counts(bare)}, null::double as spaced_share, {NO_LENGTHS}, {number_stats(bare)}"
    return f"{counts(bare)}, {spaced(bare)} as spaced_share, {length_stats(bare)}, {NO_NUMBERS}"


def classes(average: str) -> str:
    return f"""case when {average} is null then 'unknown' when {average} < 10 then 'code'
  when {average} < 50 then 'short_text' when {average} < 200 then 'meaningful_text' else 'rich_content' end
    as content_class,
  coalesce({average} >= 50, false) as is_natural_language, coalesce({average} < 10, false) as is_structured"""


SPARSITY = """case when {0} is null then 'unknown' when {0} <= 10 then 'low' when {0} <= 30 then 'medium'
  when {0} <= 70 then 'high' else 'very_high' end"""
CARDINALITY = """case when {0} is null then 'unknown' when {0} <= 0.01 then 'low' when {0} >= 0.9 then 'high'
  else 'medium' end"""


def exact_count(table: str, col: str) -> str:
    return f"""select '{table}' as table_name, '{col}' as column_name, count(distinct {col}) as distinct_count,
  true as is_close from {table}"""


def sparsity_cardinality(col: str, text: bool) -> str:
    ratio = f"(count(distinct {col}) / count({col}))"
    nulls = f"((count(*) - count({col})) / count(*) * 100)"
    lengths = (
        f"{rnd(f'avg(length({col}))', 2)} as avg_length, max(length({col}))::bigint as max_length"
        if text
        else "null::double as avg_length, null::bigint as max_length"
    )
    return f"""'{col}' as column_name, '{"text" if text else "numeric"}' as kind, count(*) as total_rows,
  count({col}) as non_null_count, {rnd(nulls, 2)} as null_percentage, {SPARSITY.format(nulls)} as sparsity,
  count(distinct {col}) as distinct_count, {rnd(ratio, 4)} as unique_ratio,
  {CARDINALITY.format(ratio)} as cardinality, {lengths}"""


PROPS = """(select event_id, case when event_id % 10 = 0 then 'oops' when event_id % 7 <> 0 then props end as props
  from events)"""


def json_profile(source: str) -> str:
    def rate(condition: str) -> str:
        return rnd(f"count(*) filter ({condition}) / count(*) * 100", 2)

    return f"""select 'props' as column_name, count(*) as sampled_values, {rate("json_valid(props)")} as valid_json_rate,
  {rate("case when json_valid(props) then json_type(props) = 'OBJECT' else false end")} as object_rate,
  {rate("case when json_valid(props) then json_type(props) = 'ARRAY' else false end")} as array_rate,
  count(*) filter (json_valid(props)) / count(*) >= 0.9 as is_valid_structure
from {source} where props is not null"""


def natural(table: str, col: str, checked: str) -> str:
    average = rnd(f"avg(length({col}))", 2)
    return f"""select '{table}' as table_name, '{col}' as column_name, avg_length, max_length, content_class,
  case when tested then spaced >= 0.5 else is_natural_language end as is_natural_language, is_structured,
  checked_values, case when tested then {rnd("spaced * 100", 2)} end as sample_with_spaces_rate
from (select *, avg_length >= 50 and checked_values > 0 as tested from
  (select *, {classes("avg_length")} from
    (select {average} as avg_length, max(length({col}))::bigint as max_length from {table}))
  join (select count(*) as checked_values, avg(case when contains({col}, ' ') then 1.0::double else 0.0 end) as spaced
    from {checked}) on true)"""


def few_values(table: str, col: str) -> str:
    order = md5_order(UNIQUE[table])
    return f"""(select * from (select * from {table} order by {order} limit 100)
  where length({col}) > 20 order by {order} limit 10)"""


def sampled_lengths(table: str, col: str) -> str:
    return f"""select '{DATABASE}' as database_name, '{SCHEMA}' as schema_name, '{table}' as table_name,
  '{col}' as column_name, count(*) as total_rows_sampled, count({col}) as non_null_count,
  {settled(f"coalesce(avg(length({col})), 0.0::double)")} as avg_length, max(length({col}))::int as max_length,
  min(length({col}))::int as min_length
from (select * from {table} order by {md5_order(UNIQUE[table])} limit 1000)"""


def adaptive(table: str, col: str) -> str:
    keys = md5_order(UNIQUE[table])
    return f"""select '{table}' as table_name, '{col}' as column_name, count(*) as total_rows, {length_stats(col)},
  any_value(size)::int as sample_size
from (select *, row_number() over (order by {keys}) as rn from {table}),
  (select case when 10000 * per_row <= 1000000 then 10000 when 1000 * per_row <= 1000000 then 1000 else 100 end as size
    from (select sum(octet_length(encode({col}))) / count(*) as per_row from {table})) where rn <= size"""


def crawl_type(field: str) -> str:
    return f"""case {field} when 'VARCHAR' then 'VARCHAR' when 'BIGINT' then 'INTEGER' when 'INTEGER' then 'INTEGER'
  when 'TIMESTAMP' then 'TIMESTAMP_NTZ' when 'FLOAT[]' then 'ARRAY' else {field} end"""


LAKE = f"'{DATABASE}' as database_name, '{SCHEMA}' as schema_name"
NESTED_EVENTS = f"select event_id, props, {fixtures.NESTED} as nested from events"
KEY_COUNTS = "\nunion all ".join(
    f"""select '{c}' as column_name, json_key, count(*) as n
from (select unnest(json_keys(case when json_valid({c}) and json_type({c}) = 'OBJECT' then {c} else '{{}}' end)) as json_key
  from ({NESTED_EVENTS})) group by 2"""
    for c in ("props", "nested")
)
LAKE_SCHEMA = COLUMNS | {"embeddings": ["vec_id", "embedding", "label"]}
LAKE_COLUMNS = (
    "("
    + "\nunion all ".join(
        f"""select {LAKE}, '{t}' as table_name, '{c.split(":")[0]}' as column_name, {i}::bigint as ordinal_position,
  {crawl_type(f"any_value(typeof({c.split(':')[0]}))")} as data_type from {t}"""
        for t, cols in LAKE_SCHEMA.items()
        for i, c in enumerate(cols, 1)
    )
    + ")"
)
REASONS = """concat_ws('; ',
  case when nulls <= 50 then printf('Good completeness (%.1f%% populated)', 100 - nulls)
    else printf('High sparsity (%.1f%% NULL)', nulls) end,
  case when reads_text and known_length < 30 then printf('Short content (avg %.1f chars)', known_length)
    when reads_text and known_length >= 30 then printf('Substantial content (avg %.1f chars)', known_length) end,
  case when reads_text and not is_natural_language then 'Content appears to be codes/structured, not natural language'
    when reads_text and is_natural_language then 'Natural language content detected' end,
  case when feature = 'extract' and not is_valid_structure then 'Invalid JSON structure detected'
    when feature = 'extract' and is_valid_structure then 'Valid JSON structure confirmed' end,
  case when data_readiness >= 3.5 then printf('Good data readiness (%.2f)', data_readiness)
    else printf('Low data readiness score (%.2f)', data_readiness) end)"""
FILL = """case when total_rows_sampled > 0
  then 100 - coalesce(non_null_count, 0) / total_rows_sampled * 100 else 100.0::double end"""
GRADE = f"""case when {FILL} < 30 and coalesce(avg_length, 0) > 50 then 'Good' when {FILL} < 60 then 'Fair'
  else 'Poor' end"""
TIMES = ("o_orderdate", "l_shipdate", "ts")
#: Every text column of the lake: a plain string may be as long as a text may be, so all are candidates.
SCANNED = [(t, c) for t, cols in COLUMNS.items() for c in cols if ":" not in c and c not in TIMES]


def lake_candidate(table: str, col: str) -> str:
    """Score parts of a text column without a comment."""
    risk = 5.0 if any(w in x.upper() for w in st.RISK_WORDS for x in (table, col)) else 2.0
    return f"""select {LAKE}, '{table}' as table_name, '{col}' as column_name, 'llm' as feature,
  0.0::double as null_percentage, {rnd(f"avg(length({col}))", 2)} as avg_length, max(length({col}))::bigint as longest,
  {spaced(col)} >= 0.5 as has_words,
  4.0::double as business_potential, 2.0::double as metadata_quality, {risk}::double as governance_risk from {table}"""


VECTOR = f"""select {LAKE}, 'embeddings' as table_name, 'embedding' as column_name, 'extract' as feature,
  {rnd("(1 - count(embedding) / count(*)) * 100", 2)} as null_percentage, null::double as avg_length,
  null::bigint as longest, null::boolean as has_words, 3.0::double as business_potential, 2.0::double as metadata_quality,
  2.0::double as governance_risk from embeddings"""
LAKE_SCORED = (
    f"(select *, {null_points('null_percentage')} + {length_points('avg_length')} as data_readiness from ("
    + "\nunion all ".join([*(lake_candidate(t, c) for t, c in SCANNED), VECTOR])
    + "))"
)
LAKE_FORECAST = f"""(select {LAKE}, table_name, null::varchar as column_name, 'forecast' as feature,
  5.0::double as business_potential, 3.0::double as data_readiness, 2.0::double as metadata_quality,
  2.0::double as governance_risk from {LAKE_COLUMNS} group by table_name
  having bool_or(data_type like 'TIMESTAMP%') and bool_or(data_type in ('INTEGER', 'DOUBLE')))"""
LAKE_SEARCH = f"""(select {LAKE}, table_name, null::varchar as column_name, 'search' as feature,
  4.0::double as business_potential, 3.0::double as data_readiness, 2.0::double as metadata_quality,
  2.0::double as governance_risk from {LAKE_COLUMNS} group by table_name
  having count(*) filter (data_type = 'VARCHAR') >= 2)"""

SELECTS: dict[str, str] = {
    # Catalog and sources
    "catalog_tables": """select * replace (cast(created as varchar) as created, cast(last_altered as varchar) as last_altered)
from live_tables""",
    "catalog_columns": "select * from live_columns",
    "catalog_constraints": "select * from live_constraints",
    "catalog_storage": "select * from live_storage",
    "catalog_stages": "select * replace (cast(created as varchar) as created) from live_stages",
    "catalog_databases": "select distinct database_name from fx_tables where deleted is null",
    "catalog_schemas": "select distinct database_name, schema_name from fx_tables where deleted is null",
    "crawl_columns": f"""select {K4}, ordinal_position, data_type, 'YES' as is_nullable
from {LAKE_COLUMNS}""",
    "crawl_tables": "\nunion all ".join(
        f"select {LAKE}, '{t}' as table_name, 'BASE TABLE' as table_type, count(*) as row_count from {t}"
        for t in ALL_TABLES
    ),
    "scan_table_column": "select doc_id, lang from documents",
    "sample_rows_by_key": f"""select event_id, event_type, value from events order by {md5_order(["event_id"])}
limit 1000""",
    "load_inventory": f"""select {K4}, 0::bigint as ordinal_position, data_type, character_maximum_length,
  null::bigint as numeric_precision, null::bigint as numeric_scale, 'YES' as is_nullable,
  coalesce(column_comment, '') as column_comment from live_columns""",
    "inventory_sets": f"""select 'databases' as metric, count(distinct database_name) as value from live_columns
union all select 'schemas', count(*) from (select distinct database_name, schema_name from live_columns)
union all select 'tables', count(*) from (select distinct {K3} from live_columns)""",
    "load_candidates": f"""select {K5}, data_type, max_length, reason, array_to_string(numeric_columns, ',') as numeric_columns,
  array_to_string(text_columns, ',') as text_columns from candidates""",
    "load_profile_cache": "\nunion all ".join(
        f"""select {LAKE}, '{t}' as table_name, '{c}' as column_name, count(*) as total_rows,
  max(length({c}))::bigint as max_length, 'full_scan' as analysis_type from {t}"""
        for t, cols in TEXTS.items()
        for c in cols
    ),
    # Filters and name rules
    "live_rows": f"select {K4}, ordinal_position, data_type from fx_columns where deleted is null",
    "filter_databases_include": f"""select {K3}, cast(created as varchar) as created from fx_tables
where upper(database_name) in ('DB_0', 'DB_3')""",
    "filter_databases_exclude": f"""select {K3}, cast(created as varchar) as created from fx_tables
where upper(database_name) not in ('DB_0', 'DB_3')""",
    "not_system_schema": f"select {K3}, cast(created as varchar) as created from fx_tables where schema_name <> 'S_3'",
    "analyzable": f"select {K5} from candidates where feature in ('llm', 'extract') and column_name is not null",
    "name_matches": f"""select {K4}, {words("column_name", st.TEXT_WORDS)} as has_text_word,
  {like("column_name", st.PII_PATTERNS)} as like_pii from live_columns""",
    "type_families": f"select {K4}, {FAMILY} as family from live_columns",
    "full_names": f"select {name()} as name, {name(20)} as clipped from live_columns",
    "content_sample": f"select doc_id, text from {few_values('documents', 'text')}",
    # Joins
    "readiness_inputs": """select * exclude (table_type, table_comment, created)
  replace (cast(last_altered as varchar) as last_altered, array_to_string(constraint_types, ',') as constraint_types)
from inputs""",
    "table_keys": f"select {K3} from live_tables union select {K3} from live_columns",
    "candidate_stats": "select * exclude (comment, t) from with_stats",
    "candidate_profile": f"""select {K5}, total_rows_sampled, non_null_count, null_percentage, avg_length,
  is_natural_language, is_valid_structure from profiled""",
    "confirmed_flag": f"select {K5}, is_confirmed as in_confirmed from scored",
    "json_explode": "select event_id, unnest(json_keys(props)) as json_key from events",
    "search_confirmed": f"""select {K3}, reason from scored s where feature = 'search' and exists (select 1 from scored c
  where c.is_confirmed and c.database_name = s.database_name and c.schema_name = s.schema_name
    and c.table_name = s.table_name)""",
    "new_candidates": "select * from fresh",
    "cache_miss": f"""select distinct {K4} from candidates where feature in ('llm', 'extract')
  and ({K4}) not in (select ({K4}) from fx_profiles)""",
    # Candidates
    "llm_candidates": "select * from llm",
    "extract_candidates": "select * from extract",
    "forecast_candidates": "select * replace (array_to_string(numeric_columns, ',') as numeric_columns) from forecast",
    "search_candidates": "select * replace (array_to_string(text_columns, ',') as text_columns) from search",
    "all_candidates": """select * replace (array_to_string(numeric_columns, ',') as numeric_columns,
  array_to_string(text_columns, ',') as text_columns) from candidates""",
    "text_rich_columns": "select * from rich",
    "enhanced_llm": f"""select {K4}, 'llm' as feature, data_type, character_maximum_length as max_length,
  column_comment as comment, 'Text column ''' || column_name || '''' as reason from rich""",
    "enhanced_search": "select * replace (array_to_string(text_columns, ',') as text_columns) from rich_tables",
    "domain_tables": "select * from domain",
    "domain_subset": f"""select count(*) as domain_tables, count(*) filter (
  {words("database_name || ' ' || schema_name || ' ' || table_name", ["STUDENT"])}) as subset_tables from domain""",
    "document_columns": "select * from documents_like",
    "pii_columns": "select * from pii",
    "pii_category": "select * from pii_named",
    "pii_categories": "select category, count(*) as columns from pii_named group by category",
    "custom_pii": "\nunion all ".join(
        f"select {K4}, '{n}' as category from live_columns where regexp_matches(column_name, '(?i){'|'.join(w)}')"
        for n, w in CUSTOM_PII
    ),
    "scope_estimate": f"""select unnest(['databases', 'tables', 'discovery_seconds', 'columns', 'estimated_candidates',
    'profiling_seconds']) as metric,
  unnest([databases, tables, databases * 2, columns, found, least(found, 200) * 5]) as value
from (select count(distinct database_name) as databases, count(*) as tables from fx_tables where deleted is null),
  (select count(*) as columns, count(*) filter ({words("data_type", st.SCOPE_TYPE_PARTS)}
    and {words("column_name", st.TEXT_WORDS)}) as found from fx_columns where deleted is null)""",
    "stage_opportunities": "select count(*) as stages from live_stages",
    # Profiling
    "numeric_profile": per_column(NUMBERS, lambda c: f"{counts(c)}, {number_stats(c)}"),
    "text_profile": per_column(TEXTS, lambda c: f"{counts(c)}, {length_stats(c)}"),
    "sparsity_cardinality": "\nunion all ".join(
        f"select '{t}' as table_name, {sparsity_cardinality(c, c in TEXTS.get(t, []))} from {t}"
        for t in (*TEXTS, "labels")
        for c in (*TEXTS.get(t, []), *NUMBERS.get(t, []))
    ),
    "sparsity_cardinality_approx": "\nunion all ".join(
        exact_count(t, c) for t in (*TEXTS, "labels") for c in (*TEXTS.get(t, []), *NUMBERS.get(t, []))
    ),
    "approx_distinct": "\nunion all ".join(exact_count(t, c.split(":")[0]) for t, cols in COLUMNS.items() for c in cols),
    "content_profile": "\nunion all ".join(
        f"""select '{t}' as table_name, '{c}' as column_name, avg_length, max_length, {classes("avg_length")} from
  (select {rnd(f"avg(length({c}))", 2)} as avg_length, max(length({c}))::bigint as max_length from {t})"""
        for t, cols in TEXTS.items()
        for c in cols
    ),
    "json_profile": json_profile(f"(select * from {PROPS} order by {md5_order(['event_id'])} limit 1000)"),
    "json_profile_whole": json_profile(PROPS),
    "natural_language": "\nunion all ".join(
        natural(t, c, few_values(t, c))
        for t, c in (("documents", "text"), ("pages", "url"), ("benchmark", "text"), ("conversations", "text"))
    ),
    "natural_language_whole": "\nunion all ".join(
        natural(t, c, f"{t} where length({c}) > 20") for t, c in (("documents", "text"), ("pages", "html"))
    ),
    "sampled_text_profile": "\nunion all ".join(
        sampled_lengths(t, c)
        for t, c in (("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "html"))
    ),
    "json_top_keys": f"""select distinct 'props' as column_name, json_key from
  (select unnest(json_keys(props)) as json_key from (select * from events order by {md5_order(["event_id"])} limit 100))""",
    "sampled_text_profile_whole": "\nunion all ".join(
        sampled_lengths(t, c).replace(f"(select * from {t} order by {md5_order(UNIQUE[t])} limit 1000)", t)
        for t, c in (("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "html"))
    ),
    "json_top_keys_whole": """select distinct 'props' as column_name, unnest(json_keys(props)) as json_key from events""",
    "json_path_types": """select json_key as path, case json_type(props, '$.' || json_key) when 'UBIGINT' then 'INTEGER'
    when 'BIGINT' then 'INTEGER' else json_type(props, '$.' || json_key) end as type, count(*) as n
from (select props, unnest(json_keys(props)) as json_key from events) group by 1, 2""",
    "json_path_types_nested": f"""select ltrim(regexp_replace(substring(fullkey, 2), '\\[\\d+\\]', '.[]', 'g'), '.') as path,
  case type when 'UBIGINT' then 'INTEGER' when 'BIGINT' then 'INTEGER' when 'NULL' then 'NULL_VALUE' when 'DOUBLE' then 'DECIMAL'
    else type end as type, count(*) as n
from (select case when json_valid(nested) then nested else 'null' end as j from ({NESTED_EVENTS})) e, json_tree(e.j) t
where fullkey <> '$' group by 1, 2""",
    "json_key_counts": KEY_COUNTS,
    "measured_json_profile": f"""select {LAKE}, 'events' as table_name, column_name, 'VARIANT' as data_type,
  array_to_string(list(json_key order by n desc, json_key)[1:20], ',') as top_keys from ({KEY_COUNTS}) group by column_name""",
    "adaptive_sample": "\nunion all ".join(
        adaptive(t, c) for t, c in (("documents", "text"), ("pages", "html"), ("benchmark", "text"))
    ),
    "full_scan_top_n": f"""select * exclude (has_words), business_potential + data_readiness + metadata_quality + governance_risk as total_score
from {LAKE_SCORED}""",
    "json_extract_text": """select event_id, json_extract_string(props, '$.k') as k from events
where json_extract_string(props, '$.k') is not null""",
    "profile_table": per_column(COLUMNS, profile_any),
    "profile_status": "\nunion all ".join(
        f"""select {LAKE}, '{t}' as table_name, '{c.split(":")[0]}' as column_name, 'success' as status,
  null as error, count({c.split(":")[0]}) as non_null_count from {t}"""
        for t, cols in LAKE_SCHEMA.items()
        for c in cols
    )
    + f"""\nunion all select {LAKE}, 'documents', 'summary', 'error', 'column not found', null
union all select {LAKE}, 'archive', 'text', 'error', 'table not found', null""",
    # Classifiers
    "sparsity_class": f"select {K4}, {SPARSITY.format('null_percentage')} as sparsity from fx_profiles",
    "cardinality_class": f"""select {K4}, {CARDINALITY.format("(non_null_count / total_rows_sampled)")} as cardinality
from fx_profiles""",
    "content_class": f"select {K4}, {classes('avg_length')} from fx_profiles",
    "text_quality_grade": f"select {K4}, {rnd(FILL, 4)} as sparsity, {GRADE} as quality from fx_profiles",
    "recommended_functions": f"""select {K4}, concat_ws(',',
  case when coalesce(avg_length, max_length, 100.0) > 200 then 'summarize' end, 'sentiment', 'classify',
  case when {words("column_name", ["DESCRIPTION", "CONTENT"])} then 'translate' end) as functions
from scored where feature = 'llm'""",
    # Estimates
    "column_metadata_stats": "select * from stats",
    "metadata_readiness_points": f"""select {K5}, case when source is null then 1.0::double else least(5.0,
  {null_points("coalesce(null_percentage, 50.0)")} + {length_points("avg_length")}
  + (has_comment::int + (is_nullable = 'NO')::int) * 0.5::double) end as readiness from with_stats""",
    "data_readiness_points": f"""select {K5}, case when has_profile then {MEASURED} else 1.0 end as readiness
from profiled""",
    "estimated_text_profile": f"""select {K4}, data_type, 0::bigint as total_rows_sampled, 0::bigint as non_null_count,
  {GUESS} as avg_length,
  case when character_maximum_length > 0 then character_maximum_length else 16777216 end as max_length,
  0::bigint as min_length
from ({first_row(f"(select * from rich)", K3,
                 "ordinal_position, column_name")})""",
    "estimated_json_profile": f"select {K4}, data_type, '' as top_keys from extract",
    "document_text_fitness": "\nunion all ".join(
        f"""select {counts(c)}, min(length({c}))::bigint as min_length, max(length({c}))::bigint as max_length,
  {rnd(f"avg(length({c}))", 2)} as avg_length, {rnd(f"quantile_cont(length({c})::double, 0.5)", 2)} as median_length,
  {rnd(f"quantile_cont(length({c})::double, 0.95)", 2)} as p95_length,
  {SPARSITY.format(f"((1 - count({c}) / count(*)) * 100)")} as sparsity,
  case when avg(length({c})) < 10 then 'code' when avg(length({c})) < 50 then 'short_text'
    when avg(length({c})) < 200 then 'meaningful_text' else 'rich_content' end as content_class,
  avg(length({c})) >= 50 as is_natural_language,
  {null_points(f"((1 - count({c}) / count(*)) * 100)")} + {length_points(f"avg(length({c}))")} as data_readiness
from documents"""
        for c in ("text", "lang", "source")
    ),
    # Table readiness
    **{f"score_{d}": f"select {K3}, {d} from dimensions" for d in DIMS.split(", ")},
    "table_readiness": f"""select {K3}, total_score, {DIMS}, {present("table_comment")} as has_table_comment,
  commented_columns, total_columns,
  case when total_columns > 0 then {rnd("commented_columns / total_columns * 100", 1)} else 0.0::double end
    as comment_coverage,
  unsupported_columns, coalesce(array_to_string(constraint_types, ','), '') as constraint_types, table_type, row_count,
  bytes, cast(created as varchar) as created, cast(last_altered as varchar) as last_altered,
  coalesce(clustering_key, '') as clustering_key from readiness""",
    "all_readiness": f"select {K3}, total_score from readiness order by {BY_SCORE}",
    "readiness_summary": f"""select count(*) as total_tables, {rnd("avg(total_score)", 2)} as average_score,
  count(*) filter (total_score >= 70) as high_readiness,
  count(*) filter (total_score >= 40 and total_score < 70) as medium_readiness,
  count(*) filter (total_score < 40) as low_readiness, sum(total_columns)::bigint as total_columns,
  (select count(*) from live_constraints) as total_constraints from readiness""",
    "top_tables": top(f"{name(55, K3)} as name, total_score, {DIMS}, row_count", "readiness", BY_SCORE, 30),
    "missing_comments": top(
        f"{name(50, K3)} as name, comments, commented_columns, total_columns",
        "(select * from readiness where comments < 20)", BY_SCORE, 15,
    ),
    "stale_tables": top(
        f"{name(50, K3)} as name, freshness, cast(last_altered as varchar) as last_altered",
        "(select * from readiness where freshness <= 25)", BY_SCORE, 15,
    ),
    "unsupported_columns": f"""select {K4}, ordinal_position, data_type,
  column_name || ' (' || upper(data_type) || ')' as label from live_columns where {FAMILY} = 'unsupported'""",
    "unsupported_types": f"""select rank, {name(50, "t.database_name, t.schema_name, t.table_name")} as name, total_score,
  array_to_string(labels[1:3], ', ') as columns
from ({top(f"{K3}, total_score", "(select * from readiness where unsupported_columns > 0)", BY_SCORE, 15)}) t
  join (select {K3}, list(column_name || ' (' || upper(data_type) || ')' order by ordinal_position, column_name) as labels
    from live_columns where {FAMILY} = 'unsupported' group by {K3}) u using ({K3})""",
    "scan_savings": """select count(*) as tables, count(*) * 3 as table_scans, 4::bigint as metadata_queries
from readiness""",
    # Candidate scores
    "score_candidate": f"""select * exclude (first_readiness), business_potential + data_readiness + metadata_quality
  + governance_risk as total_score
from (select {K5}, business_potential, first_readiness, first_readiness as data_readiness, metadata_quality,
  governance_risk from first_scored)""",
    "score_candidate_inverted": f"""select {K5}, business_potential, first_readiness as data_readiness, metadata_quality,
  governance_risk, business_potential + first_readiness + metadata_quality + 6 - governance_risk as total_score
from first_scored""",
    "rescored": f"select {SCORED} from rescored",
    "rescored_from_metadata": f"""select *, business_potential + data_readiness + metadata_quality + governance_risk as total_score
from (select {K5}, f.business_potential, f.metadata_quality, f.governance_risk,
  case when source is null then first_readiness else least(5.0,
    {null_points("coalesce(w.null_percentage, 50.0)")} + {length_points("w.avg_length")}
    + (has_comment::int + (is_nullable = 'NO')::int) * 0.5::double) end as data_readiness
  from (select {K5}, business_potential, metadata_quality, governance_risk, first_readiness,
      coalesce(column_name, '') as c from first_scored) f
    join (select {K3}, feature, coalesce(column_name, '') as c, null_percentage, avg_length, has_comment, is_nullable,
      source from with_stats) w using ({K3}, feature, c))""",
    "top_candidates": f"select {SCORED} from top",
    "confirm": f"select {K5}, is_confirmed from scored",
    "confirm_tables": f"""select {K3}, feature, {settled("mean_nulls")} as null_percentage, {settled("mean_length")} as avg_length,
  {settled("data_readiness")} as data_readiness,
  {settled("business_potential + data_readiness + metadata_quality + governance_risk")} as total_score,
  coalesce(mean_nulls, 100.0) <= 50 and data_readiness >= 3.5 and not (feature = 'search'
    and (coalesce(nullif(mean_length, 0.0) < 30, false) or coalesce(not prose, false))) as is_confirmed
from (select {K3}, feature, mean_nulls, mean_length, prose, coalesce(ready, first_readiness) as data_readiness, business_potential,
    metadata_quality, governance_risk
  from (select * exclude (null_percentage, avg_length) from first_scored where column_name is null) left join (
    select {K3}, feature, {mean("null_percentage")} as mean_nulls, {mean("avg_length")} as mean_length,
      avg(case when is_natural_language then 1.0::double when not is_natural_language then 0.0 end) >= 0.5 as prose,
      avg({MEASURED}) as ready
    from (select m.*, p.null_percentage, p.avg_length, p.max_length as longest, c.character_maximum_length as max_length, p.is_natural_language
      from (select distinct {K3}, feature, unnest(coalesce(numeric_columns, text_columns)) as column_name
          from candidates where column_name is null) m
        join fx_profiles p using ({K4}) left join live_columns c using ({K4}))
    group by {K3}, feature) using ({K3}, feature))""",
    "confirm_reasons": f"select {K5}, {REASONS} as reasons from scored",
    "confirmed_only": f"select {SCORED} from scored where is_confirmed",
    "priority_tier": f"select {K5}, priority from scored",
    "priority_counts": """select priority, count(*) as candidates, count(*) filter (is_confirmed) as confirmed from scored
group by priority""",
    "feature_by_tier": "select feature, "
    + ", ".join(f"count(*) filter (priority = '{t}') as {t}" for t in ("P1", "P2", "P3"))
    + " from scored group by feature",
    "dimension_assessment": f"""select {K5},
  case when business_potential >= 4 then 'High value' else 'Moderate value' end as business,
  case when data_readiness >= 4 then 'Ready' else 'Needs validation' end as readiness,
  case when metadata_quality >= 3 then 'Well documented' else 'Limited docs' end as documentation,
  case when governance_risk <= 3 then 'Low risk' else 'Review needed' end as risk from scored""",
    # Reports
    "quality_overview": f"""select total, analyzed, high_quality, low_quality, {share("analyzed", "total")} as analysis_rate,
  (select count(*) from top) as full_scans, errors
from (select count(*) as total, count(*) filter (has_profile) as analyzed,
  count(*) filter (data_readiness >= 4) as high_quality, count(*) filter (data_readiness <= 1.5) as low_quality,
  count(*) filter (not has_profile and column_name is not null) as errors from scored)""",
    "over_provisioned": top(
        f"{name(60)} as name, max_length as declared_length, avg_length, {rnd('efficiency', 4)} as efficiency, "
        "cast(floor(avg_length * 2) as bigint) as suggested_length",
        "(select *, avg_length / max_length * 100 as efficiency from scored where max_length > 0 and avg_length > 0 "
        "and avg_length / max_length * 100 < 25)",
        f"efficiency, {BY_CANDIDATE}", 20,
    ),
    "high_quality": top(
        f"{name(60)} as name, total_score, coalesce(avg_length, 0.0) as avg_length, nulls as null_percentage, feature",
        "(select * from scored where data_readiness >= 4)", f"total_score desc, {BY_CANDIDATE}", 30,
    ),
    "reconsider": top(
        f"""{name(60)} as name, total_score, data_readiness, case when nulls > 50 then 'High NULL rate'
  when avg_length > 0 and avg_length < 50 then 'Short content' else 'Low quality' end as issue,
  case when nulls > 50 then printf('%.1f%% NULLs', nulls)
  when avg_length > 0 and avg_length < 50 then printf('Avg %.1f chars', avg_length) else 'Multiple factors' end
    as detail""",
        "(select * from scored where data_readiness <= 1.5)", BY_CANDIDATE, 20,
    ),
    "quality_by_feature": f"""select *, {share("analyzed", "total")} as analysis_rate
from (select feature, count(*) as total, count(*) filter (has_profile) as analyzed,
  count(*) filter (data_readiness >= 4) as high_quality, {rnd("avg(data_readiness)", 2)} as average_readiness
  from scored group by feature)""",
    "score_movers": movers("select *, 3.0::double as before from scored"),
    "score_movers_since": movers(f"""select s.*, case when s.governance_risk < 5 then s.data_readiness else f.first_readiness end as before
from scored s join (select {K3}, feature, coalesce(column_name, '') as c, first_readiness from first_scored) f
  on s.database_name = f.database_name and s.schema_name = f.schema_name and s.table_name = f.table_name
    and s.feature = f.feature and coalesce(s.column_name, '') = f.c"""),
    "score_shift_summary": f"""select *, total - with_data as without_data, {share("high", "with_data")} as high_rate,
  {share("low", "with_data")} as low_rate
from (select count(*) as total, count(*) filter (has_profile) as with_data,
  {rnd("avg(data_readiness) filter (has_profile)", 2)} as average_readiness,
  count(*) filter (has_profile and data_readiness >= 4) as high,
  count(*) filter (has_profile and data_readiness <= 1.5) as low,
  count(*) filter (has_profile and data_readiness > 3) as improved,
  count(*) filter (has_profile and data_readiness < 3) as declined from scored)""",
    "feature_distribution": "select feature, count(*) as candidates from candidates group by feature",
    "feature_confirmation": """select feature, count(*) as candidates, count(*) filter (is_confirmed) as confirmed,
  max(total_score) as top_score from scored group by feature""",
    "top_opportunities": top(
        f"{name(60)} as name, feature, total_score, substring(reason, 1, 50) as rationale", "scored",
        f"total_score desc, {BY_CANDIDATE}", 10,
    ),
    "schema_profiles": f"""select {K5}, rank, group_size, total_score, reason, data_type, {SCORES} from (
  select *, row_number() over (partition by database_name, schema_name, feature
      order by total_score desc, table_name nulls first, column_name nulls first)::int as rank,
    count(*) over (partition by database_name, schema_name, feature) as group_size from scored) where rank <= 20""",
    "database_breakdown": f"""select *, {share("confirmed", "candidates")} as confirmation_rate
from (select database_name, count(distinct (schema_name, table_name)) as tables, count(*) as candidates,
  count(*) filter (is_confirmed) as confirmed from scored group by database_name)""",
    "text_quality": top(
        f"substring(table_name || '.' || column_name, 1, 40) as name, avg_length, max_length, {rnd(FILL, 4)} as sparsity, "
        f"{GRADE} as quality", "fx_profiles", f"avg_length desc nulls last, {K4}", 20,
    ),
    "best_text_column": top(f"{name()} as name, avg_length", "fx_profiles", f"avg_length desc nulls last, {K4}", 5),
    "environment_counts": """select 'databases' as metric, count(distinct database_name) as value from live_tables
union all select 'schemas', count(distinct (database_name, schema_name)) from live_tables
union all select 'tables', count(*) from live_tables union all select 'columns', count(*) from live_columns
union all select 'stages', count(*) from live_stages union all select 'candidates', count(*) from candidates""",
    "enhanced_counts": """select 'llm_candidates' as metric, count(*) as total, least(count(*), 1000) as listed from rich
union all select 'search_candidates', count(*), least(count(*), 500) from rich_tables
union all select 'domain_tables', count(*), count(*) from domain
union all select 'document_columns', count(*), count(*) from documents_like
union all select 'pii_columns', count(*), count(*) from pii""",
    "confirmation_rate": f"""select *, {share("confirmed", "candidates")} as confirmation_rate
from (select count(*) as candidates, count(*) filter (is_confirmed) as confirmed from scored)""",
    # Windows, sorts, sets
    "latest_version": "select * replace (cast(created as varchar) as created) from live_stages",
    "first_per_table": f"""select {K4}, ordinal_position from
({first_row("live_columns", K3, "ordinal_position, column_name")})""",
    "top_k_per_group": f"""select {K5}, total_score, rank from (
  select *, row_number() over (partition by database_name, schema_name, feature
      order by total_score desc, table_name nulls first, column_name nulls first)::int as rank from scored)
where rank <= 20""",
    "rank_column": top(
        "l_orderkey, l_linenumber, l_partkey, l_extendedprice", "lineitem",
        "l_extendedprice desc, l_orderkey, l_linenumber, l_partkey", 30,
    ),
    "first_match": f"""select {K4}, min(ordinal_position) as ordinal_position from fx_columns where deleted is null
group by {K4}""",
    "order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 200",
    "union_all": f"""select {K5}, reason from llm
union all select {K3}, null as column_name, feature, reason from search""",
    "distinct_sets": f"select distinct {K3} from fx_columns",
    # Incremental work and stored results
    "incremental_profile": "\nunion all ".join(
        f"""select {LAKE}, '{t}' as table_name, '{c.split(":")[0]}' as column_name, count(*) as total_rows,
  count({c.split(":")[0]}) as non_null_count,
  {"null::bigint" if ":" in c else f"max(length(cast({c} as varchar)))::bigint"} as max_length,
  '{"first" if t in ("documents", "part") else "second"}' as analysis_type from {t}"""
        for t, cols in COLUMNS.items()
        for c in cols
    ),
    "incremental_by_file": "\nunion all ".join(
        f"""select {LAKE}, '{t}' as table_name, {counts(c.split(":")[0])}, '{kind_of(c)}' as kind, 6::bigint as files, 6::bigint as files_read, true as is_near,
  {extremes(c)} from {t}"""
        for t in UNIQUE_KEYS for c in COLUMNS[t]
    ),
    "merge_candidates": "select * from stored union all select * from fresh",
    "add_candidates": f"select * from stored union all select {K5}, reason from candidates",
    "run_history": """select '2001-01-01' as run_at, 'fresh' as mode, 'db_0,DB_3' as filter,
  array_to_string(list_sort(list(distinct database_name)), ',') as databases from stored
union all select '2001-02-01', 'append', 'ALL', array_to_string(list_sort(list(distinct database_name)), ',')
from candidates""",
    "resume_from_step": "select feature, count(*) as candidates from candidates group by feature",
    "write_outputs": "\nunion all ".join(
        f"select '{n}.{f}' as output, count(*) as rows from {src}"
        for n, src in (("confirmed", "scored where is_confirmed"), ("top", "top"))
        for f in ("parquet", "json", "csv")
    ),
    "run_mode": f"select {K5}, total_score, is_confirmed, priority from scored",
    "measured_candidates": f"""select *, case when total_score >= 15 and governance_risk <= 3 then 'P1'
  when total_score >= 12 then 'P2' else 'P3' end as priority
from (select {K5}, {SCORES}, business_potential + data_readiness + metadata_quality + governance_risk as total_score,
  feature <> 'forecast' and data_readiness >= 3.5 and null_percentage <= 50
    and coalesce(avg_length >= 50 and has_words, true) as is_confirmed
from (select * from {LAKE_SCORED} union all by name select * from {LAKE_FORECAST} union all by name select * from {LAKE_SEARCH}))""",
}

RUN_RESULTS = {
    "readiness": "all_readiness", "confirmed": "confirmed_only", "candidates": "confirm",
}
RUN_NAMES = (
    "readiness", "readiness_summary", "top_tables", "missing_comments", "stale_tables", "unsupported_types",
    "scan_savings", "candidates", "confirmed", "top_candidates", "domain_tables", "document_columns",
    "pii_columns", "pii_categories", "stage_opportunities", "environment_counts", "enhanced_counts",
    "quality_overview", "quality_by_feature", "over_provisioned", "high_quality", "reconsider",
    "score_movers", "score_shift_summary", "priority_counts", "feature_by_tier", "feature_confirmation",
    "top_opportunities", "schema_profiles", "database_breakdown", "confirmation_rate", "text_quality",
    "best_text_column",
)
SELECTS["catalog_run_results"] = "\nunion all ".join(
    f"select '{n}' as result, count(*) as rows from ({SELECTS[RUN_RESULTS.get(n, n)]})" for n in RUN_NAMES
)


#: Statements over many shared definitions, of which each is worked out once.
ONCE = {SELECTS["new_candidates"], SELECTS["rescored_from_metadata"]}


def oracle_sql() -> dict[str, str]:
    return {key: statement(select) for key, select in SELECTS.items()}
