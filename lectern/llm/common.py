"""Helpers shared by the corpus operators: shared scratch space, sizes, folds, blocks."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, named by ``spark.checkpoint.dir``.

    Only where the session names none and all its executors are on this machine (as in tests)
    is one made and set; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def parts_for(table: DataFrame, part_bytes: int = 32 << 20) -> int:
    """Parts for what is made from ``table``: one a core, more if it is large."""
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(plan_bytes(table) / part_bytes))


def staged(df: DataFrame, name: str, parts: int | None = None, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut,
    and a lost executor costs no recomputation of what came before. There are at most
    ``parts`` files (see ``parts_for``; by default one a core), or a third of that if the table
    is ``small`` beside the input, as many small files burden any store. ``discard`` removes it."""
    spark = df.sparkSession
    # shuffle files go only when the driver forgets their plans, which an idle heap never does
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{scratch_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    parts = parts or spark.sparkContext.defaultParallelism
    df.coalesce(max(1, parts // 3) if small else parts).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more: what was made from them has
    itself been staged."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(conf).delete(path, True)


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """A result that is small beside its ``source``, in few parts."""
    return df.coalesce(2 * parts_for(source))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, for a table scan the size of its files; where Catalyst has
    none, the rows are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    long = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind in ("string", "binary")]
    return df.select(F.sum(sum(long, F.lit(8 * len(df.columns)))).alias("n")).first()["n"] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` stored bytes ``df`` makes; at least one for
    each shuffle partition, so that all tasks have work."""
    return max(shuffle_partitions(df.sparkSession), math.ceil(plan_bytes(df) / block_bytes))


def utf8(text: Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for modest executors: a batch is held on
    both sides of the pipe and, as objects, in the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
