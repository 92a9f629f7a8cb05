"""Shared helpers: the cluster's shared folder, materialised tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows that a Python worker handles at a time.
ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is set where the
    session names none; a cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables and files are."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}-{name}"


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables and files, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return the table read back.

    Cuts lineage: what follows neither repeats the work nor depends on executors that
    may be lost.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of at most ``ROWS`` rows."""
    return (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def per_row(rows: DataFrame, columns: str | tuple[str, ...], fields: str | StructType, make: Callable[..., list]) -> DataFrame:
    """``rows`` with ``columns`` replaced by ``fields`` (DDL). ``make`` gets a list of values for each of
    the columns and returns a list or array of the same length for each field. All other
    columns pass as they are, as Arrow data: nulls beside them don't change their type."""
    columns = (columns,) if isinstance(columns, str) else columns
    kept, made = [f for f in rows.schema if f.name not in columns], fields if isinstance(fields, StructType) else StructType.fromDDL(fields)
    names, kinds = [f.name for f in [*kept, *made]], to_arrow_schema(made).types

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            new = [pa.array(x, k) for x, k in zip(make(*(part.column(c).to_pylist() for c in columns)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return rows.mapInArrow(each, StructType([*kept, *made]))


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, ``row``: what is worked out beside it can't clash with their names; ``select("row.*")`` gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")


def added(docs: DataFrame, keep: list[str], inputs: list[Column], fields: str, make: Callable[..., list]) -> DataFrame:
    """Columns ``keep`` of ``docs`` beside ``fields`` (DDL), which ``make`` works out from ``inputs`` as in
    ``per_row``. Inside, columns have numbers for names, so that none of ``docs`` clashes with another."""
    made = StructType.fromDDL(fields)
    rows = docs.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)), *(x.alias(f"x{i}") for i, x in enumerate(inputs)))
    numbered = StructType([StructField(f"v{i}", f.dataType) for i, f in enumerate(made)])
    return per_row(rows, tuple(f"x{i}" for i in range(len(inputs))), numbered, make).toDF(*keep, *made.names)


def keep_rows(rows: DataFrame, column: str, good: Callable[[list], np.ndarray]) -> DataFrame:
    """Those of ``rows`` for whose ``column`` ``good`` returns True; they pass untouched as Arrow data."""
    names = rows.columns
    numbered = rows.toDF(*(f"k{i}" for i in range(len(names))))  # Arrow functions take no name with a dot or backtick
    at = names.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            yield part.filter(pa.array(good(part.column(at).to_pylist()), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return numbered.mapInArrow(each, numbered.schema).toDF(*names)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected graph; root is the smallest node reachable.

    Alternating large-star and small-star rounds, each one written to the shared folder.
    The edge list never grows, and no neighbourhood is gathered in one place: hubs are
    reduced by map-side minima and joined back. Self-links and nulls are ignored, repeated
    links count once; an empty edge list gives an empty result.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = materialize(e, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("connected components did not converge")
    # stars now: every u has one v, and no v is a u
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
