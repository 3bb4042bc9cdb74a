"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import checkpoint_path, ship_package

#: A word is a maximal run of anything but these ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of whole texts that cross to Python at once, unless the session says otherwise.
ARROW_ROWS, ARROW_DEFAULT = "256", "10000"


def lean(run):
    """A task function for ``mapInArrow`` that gives freed memory back when its
    partition ends: Python workers live on, and what their allocators keep of
    one stage would add to the next."""
    def wrapped(batches):
        yield from run(batches)
        release()
    return wrapped


def release() -> None:
    """Give this process's freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc
    if trim is not None:
        trim(0)


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and keep batches of
    texts small where the session has Spark's own default."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == ARROW_DEFAULT:
        spark.conf.set(key, ARROW_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage with a table every executor can read, so losing an
    executor costs only the tasks that were running on it.
    """
    return _write(df, name)[0]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that an operator drops as soon as all that is made from
    them is written itself, so that they do not pile up in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no classifier may learn from: crc32 of the id
    written as text, modulo 3, is 1.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates ``value`` once per row and binds it to ``name``
    inside ``body`` (a one-element higher-order function)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def joined(big: DataFrame, small: DataFrame, on, how: str, most: int = 500_000) -> DataFrame:
    """Join that broadcasts ``small``, a written table of narrow rows, up to
    ``most`` rows, and leaves the way to Spark beyond."""
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)
