"""Helpers of the corpus operators: shared storage between jobs, and document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in tests, a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there, and every executor can reread it.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Columns of documents; operators name their helper columns differently.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
PACKED = "_packed"


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` with the columns that are neither those of documents nor ``read`` in one struct, where no name of theirs meets
    that of a helper column. A table without such columns stays as it is."""
    own = {c.lower() for c in (*DOCUMENT, *read)}
    others = [c for c in docs.columns if c.lower() not in own]
    if not others:
        return docs
    kept = [F.col(_named(c)) for c in docs.columns if c.lower() in own]
    return docs.select(*kept, F.struct(*(F.col(_named(c)) for c in others)).alias(PACKED))


def unpacked(found: DataFrame, columns: list[str]) -> DataFrame:
    """``found``, made from ``packed``, with the ``columns`` of the table before in their order, then those that were added."""
    if PACKED not in found.columns:
        return found
    inner = set(found.schema[PACKED].dataType.names)
    added = [c for c in found.columns if c != PACKED and c not in columns]
    return found.select(*(F.col(f"{PACKED}.{_named(c)}" if c in inner else _named(c)) for c in columns), *added)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 length of a text; null counts as none."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
