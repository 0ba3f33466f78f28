"""Catalog views derived from the business tables by integer arithmetic.

The same text runs in Spark and in the oracle: table names are placeholders. Every input row takes part in every view.
Keys that are to stand in one view only get another table name there.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2001, 8, 1)

INPUTS = ("customer", "nation", "orders", "supplier")


def word(words: str, index: str) -> str:
    return f"split_part('{words}', ',', cast({index} as int) + 1)"




def keys(alone: str, mark: str) -> str:
    """Database, schema and table; where ``alone`` holds, a table name that no other view has."""
    return f"""'DB_' || n_regionkey as database_name, 'S_' || c_nationkey as schema_name,
  {word("ARTICLES,STUDENT,SALES,LOG,COURSE_CONTENT,EMAIL_QUEUE,METRICS,CUSTOMER_NAME", "c_custkey % 8")}
    || '_' || c_custkey || case when {alone} then '_{mark}' else '' end as table_name"""


#: JSON of several depths made from a row of events, in SQL of either engine; some is none.
NESTED = """case event_id % 5
  when 0 then '{"id": ' || event_id || ', "user": {"id": ' || user_id || ', "tags": ["x", ' || user_id || ', null, {"deep": {"er": [true, 1.5]}}]}, "ok": true}'
  when 1 then '[{"a": {"b": {"c": {"d": [[' || event_id || ', "z"]], "id": {}}}}}, []]'
  when 2 then 'no json' when 3 then '"text"' else props end"""

_CUSTOMERS = "{customer} c join {nation} n on c.c_nationkey = n.n_nationkey"
_ORDERS = _CUSTOMERS + " join {orders} o on o.o_custkey = c.c_custkey"

_COLUMN_NAMES = (
    "DESCRIPTION,CONTENT,MESSAGE,EMAIL,FIRST_NAME,STATUS_CODE,AMOUNT,CREATED_AT,FILE_PATH,PAYLOAD,TITLE,"
    "SSN,BIO,PHONE,S3_KEY,SCORE,ADDRESS,NOTES,EVENT_DATE,TAGS,BLOB_DATA,GEO,PASSWORD,DOB"
)
_COLUMN_TYPES_HEAD = "VARCHAR,TEXT,VARCHAR(200),NUMBER,FLOAT,DATE,TIMESTAMP_NTZ(9),VARIANT,OBJECT,ARRAY"
_COLUMN_TYPES = _COLUMN_TYPES_HEAD + ",BINARY,GEOGRAPHY,BOOLEAN,TIME,STRING,INT,text"
_COLUMN_NAME = f"{word(_COLUMN_NAMES, 'o_orderkey % 24')} || '_' || o_orderkey as column_name"


def _tables(ver: int) -> str:
    return f"""
select {keys("c_custkey % 29 = 0", "T")},
  case when c_custkey % 5 = 0 then 'VIEW' else 'BASE TABLE' end as table_type,
  c_custkey * 37 as row_count, c_custkey * 2500000 as bytes,
  case c_custkey % 3 when 0 then 'about ' || c_mktsegment when 1 then '  ' end as table_comment,
  date '2000-01-0{1 + ver}' as created,
  case when c_custkey % 17 <> 0 then date '2001-08-01' - cast(c_custkey % 400 as int) end as last_altered,
  case when c_custkey % 4 = 0 then 'LINEAR(C1)' end as clustering_key,
  case when {ver} = 0 and c_custkey % 11 = 0 then date '2000-06-01' end as deleted
from {_CUSTOMERS} where {ver} = 0 or c_custkey % 7 = 0"""


def _columns(ver: int) -> str:
    lengths = word("16777216,4000,1000,500,499,200,199,100,50,0", "floor(o_orderkey / 16) % 10")
    return f"""
select {keys("c_custkey % 31 = 0", "C")}, {_COLUMN_NAME},
  o_orderkey + {ver * 1000000} as ordinal_position,
  {word(_COLUMN_TYPES, "o_orderkey % 17")} as data_type,
  case when o_orderkey % 13 <> 0 then cast({lengths} as bigint) end as character_maximum_length,
  cast(null as bigint) as numeric_precision, cast(null as bigint) as numeric_scale,
  case when o_orderkey % 2 = 0 then 'YES' else 'NO' end as is_nullable,
  case o_orderkey % 3 when 0 then 'meaning of ' || o_orderpriority when 1 then '' end as column_comment,
  case when o_orderkey % 19 = 0 then date '2000-06-01' end as deleted
from {_ORDERS} where {ver} = 0 or o_orderkey % 23 = 0"""


def _constraints(v: int) -> str:
    kind = ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "foreign key")[v]
    return f"""
select {keys(f"c_custkey % {v + 2} <> 0", "K")}, '{kind}' as constraint_type, 'K{v}' as constraint_name,
  case when c_custkey % 37 = 0 then date '2000-06-01' end as deleted
from {_CUSTOMERS}"""


def _storage(ver: int) -> str:
    return f"""
select {keys("c_custkey % 10 = 0", "S")},
  case when c_custkey % 9 <> 0 then c_custkey * 2500000 + {ver} end as active_bytes,
  c_custkey * 1000 as time_travel_bytes,
  cast(0 as bigint) as failsafe_bytes, cast(0 as bigint) as retained_for_clone_bytes
from {_CUSTOMERS} where {ver} = 0 or c_custkey % 6 = 0"""


def _stages(ver: int) -> str:
    return f"""
select 'DB_' || n_regionkey as database_name, 'S_' || s_nationkey as schema_name,
  'STAGE_' || s_suppkey as stage_name, 's3://bucket/' || s_suppkey as stage_url,
  case when s_suppkey % 2 = 0 then 'External Named' else 'Internal Named' end as stage_type,
  s_name as comment, date '2000-01-0{1 + ver}' as created,
  case when s_suppkey % 11 = 0 then date '2000-06-01' end as deleted
from {{supplier}} s join {{nation}} n on s.s_nationkey = n.n_nationkey
where {ver} = 0 or s_suppkey % 7 = 0"""


_PROFILES = f"""
select {keys("o_orderkey % 2 <> 0", "P")}, {_COLUMN_NAME}, o_orderkey as col_id,
  cast(1000 as bigint) as total_rows_sampled,
  1000 - (o_orderkey * 7) % 1001 as non_null_count,
  cast((o_orderkey * 7) % 1001 as double) / 10 as null_percentage,
  case when o_orderkey % 5 <> 0 then cast((o_orderkey * 13) % 3000 as double) / 10 end as avg_length,
  (o_orderkey * 17) % 2000 as max_length,
  case o_orderkey % 3 when 0 then false when 1 then true end as is_natural_language,
  case o_orderkey % 4 when 0 then false when 1 then true end as is_valid_structure
from {_ORDERS}"""

SQL = {
    "fx_tables": _tables(0) + "\nunion all" + _tables(1),
    "fx_columns": _columns(0) + "\nunion all" + _columns(1),
    "fx_constraints": "\nunion all".join(_constraints(v) for v in range(4)),
    "fx_storage": _storage(0) + "\nunion all" + _storage(1),
    "fx_stages": _stages(0) + "\nunion all" + _stages(1),
    "fx_profiles": _PROFILES,
}


def oracle_text(name: str) -> str:
    return SQL[name].format(**{t: t for t in INPUTS})


class Data:
    """The given tables and the views derived from them, for one session and scale."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read from the files once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        sql = SQL[name]
        used = {t: self.table(t) for t in INPUTS if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)

    tables = cached_property(lambda self: self.view("fx_tables"))
    columns = cached_property(lambda self: self.view("fx_columns"))
    constraints = cached_property(lambda self: self.view("fx_constraints"))
    storage = cached_property(lambda self: self.view("fx_storage"))
    stages = cached_property(lambda self: self.view("fx_stages"))
    profiles = cached_property(lambda self: self.view("fx_profiles"))
