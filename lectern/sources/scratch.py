"""Tables stored in the folder that the session's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names. Only a local master, all of
    whose executors are on this machine, may do without."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lectern/{uuid.uuid4().hex}"


#: For tables whose rows are large. A reader holds up to 4096 rows of a row group at once and a writer a whole one,
#: so a row group has a few MB, counted from the eighth row on.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "8"}


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """The table written once and read from there: what is made of it more than once is not
    computed again, and a lost executor costs only its own part."""
    path = scratch_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; one without rows if nothing has been written there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
