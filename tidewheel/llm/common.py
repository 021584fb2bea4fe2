"""What the operators share: table access, the shared folder, and word counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, the same in Java's and RE2's regular expressions.
SPACE = "[ \\t\\n\\r]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset and the master is local (as in tests), a temporary folder is set;
    on a cluster a missing setting is an error, since a folder of one machine would not do.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="tidewheel-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


#: Rows of the Arrow batches that Python functions get while a table is written.
BATCH_ROWS = 512


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors.

    Arrow batches are small while it is written, which bounds the memory of texts in executors and workers; then the session's setting is back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables written() has made that are still there; for release()."""
    return len(_written)


def release(since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that written() made, but for the first ``since`` of them, and the last one if it is to stay; call it once their readers are done."""
    last = [_written.pop()] if keep_last and len(_written) > since else []
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder then goes with the cluster's own cleaning
            break
    _written.extend(last)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside go at the end: for work whose result is written elsewhere."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds few texts as Python strings at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    pa.default_memory_pool().release_unused()


#: Rows up to which a side of a join is copied to all tasks.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which is counted for it and should be written, has at most so many rows that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def on_texts(kind: str, each: Callable[[list[str | None]], list]) -> Callable[[Column], Column]:
    """A column function that gives each slice of texts to ``each``; a worker holds no more of them as Python strings at a time."""

    of = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[kind]

    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array(each(texts.slice(lo, BATCH_ROWS).to_pylist()), of) for lo in range(0, len(texts), BATCH_ROWS)]
        done = pa.concat_arrays(out) if out else pa.array([], of)
        del out
        pa.default_memory_pool().release_unused()
        return done

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def whole(docs: DataFrame) -> Column:
    """A row as the struct _row, so that a stage's own columns can't clash with any of its columns."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def words(text: Column) -> Column:
    """Number of words between SPACE; 0 for null and blank texts."""
    trimmed = F.btrim(text, F.lit(" \t\n\r"))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def words_sql(text: str) -> str:
    """DuckDB's words()."""
    trimmed = f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"
    return (
        f"CASE WHEN {text} IS NULL OR {trimmed} = '' THEN 0 "
        f"ELSE len(regexp_split_to_array({trimmed}, '[ \\t\\n\\r]+')) END"
    )
