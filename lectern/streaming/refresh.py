"""A library that follows its files: which content a path has now, and contents seen for the first time.

Both are streams with keyed state, so a batch costs what it brings and nothing that is there
already is read again. A path's state is the digest it has now and how often that changed; a path that
comes again unchanged gives no row, and one that comes without content leaves the library. A content's state is
that it was seen; it is made into passages once, under whatever paths it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CATALOG = "path string, sha string, version long"
#: Spark's setting for keyed state of any kind, and what it takes.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that wait in a task with their texts while their digests are looked at, and digests that a task remembers.
ARROW_ROWS, WAITING, REMEMBERED = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", 1 << 17


class _Versions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "sha string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        _, sha = max(((r["at"], r["sha"] or "") for r in rows))
        old, version = self.now.get() if self.now.exists() else ("", 0)
        if (old or "") != sha:
            self.now.update((sha, version + 1))
            yield Row(path=key[0], sha=sha or None, version=version + 1)

    def close(self) -> None:
        pass


def versions(files: DataFrame) -> DataFrame:
    """Changes of a streaming (path, sha, at): a row for each path whose content is not what it was; a null
    ``sha`` says that the path is gone. Of rows of one path in a batch, the last by ``at`` counts, and of those
    the one with the greatest digest."""
    return files.select("path", "sha", "at").groupBy("path").transformWithState(_Versions(), CATALOG, "append", "none")


def _first_here(digests: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a digest is the first of its kind among those that the task remembers."""
    seen: set[str] = set()
    for some in digests:
        if len(seen) > REMEMBERED:
            seen.clear()
        before = len(seen)
        new = []
        for digest in some:
            seen.add(digest)
            new.append(len(seen) > before)
            before = len(seen)
        yield pd.Series(new, dtype=bool)


def contents(files: DataFrame) -> DataFrame:
    """(sha, text) of a streaming (path, sha, text) that no earlier row had. Copies go where they are read, so a
    content that a third of all files have is moved a few times by each task; what is left is moved once to its state,
    which decides."""
    first = F.pandas_udf(_first_here, "boolean").asNondeterministic()
    return files.where("sha is not null").select("sha", "text").where(first("sha")).dropDuplicates(["sha"])


def current(catalog: DataFrame) -> DataFrame:
    """(path, sha, n_paths) of the contents that the library has now; of paths with equal content the
    first by name stands for it."""
    latest = catalog.groupBy("path").agg(F.max_by("sha", "version").alias("sha")).where("sha is not null")
    return latest.groupBy("sha").agg(F.min("path").alias("path"), F.count("*").alias("n_paths"))


@contextmanager
def with_state(spark: SparkSession):
    """Keyed state as Spark needs it for the time of a ``with`` block, and few rows at once in Python."""
    with _Setting(spark, PROVIDER, ROCKSDB), _Setting(spark, ARROW_ROWS, WAITING):
        yield


class _Setting:
    def __init__(self, spark: SparkSession, name: str, value: str):
        self.spark, self.name, self.value = spark, name, value

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.name, None)
        self.spark.conf.set(self.name, self.value)

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(self.name)
        else:
            self.spark.conf.set(self.name, self.before)
