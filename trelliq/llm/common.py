"""What the corpus operators share: the shared folder, row keys and word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Memory(dict):
    """What ``compute`` gives for strings, in two generations: when the young one holds ``size`` bytes it becomes the old one, and the
    old one goes. Strings longer than ``longest`` characters are not remembered. Bytes are reckoned from lengths."""

    def __init__(self, compute: Callable, size: int, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.held, self.old = compute, size, longest, 0, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= self.longest:
            self.held += 240 + 2 * len(key) + 8 * len(found)
            if self.held > self.size:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = found
        return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session on one machine without that setting gets a folder of its own; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "trelliq")
    return base.rstrip("/")


#: Scratch paths that were made outside of any ``scratch_run``, oldest first, and those of the run that this thread is in.
_MADE: list[str] = []
_RUN: ContextVar[list[str] | None] = ContextVar("scratch paths of this run", default=None)


def _paths() -> list[str]:
    run = _RUN.get()
    return _MADE if run is None else run


@contextmanager
def scratch_run() -> Iterator[None]:
    """Within it ``made`` and ``clear`` are about the paths of this run alone, whatever else works in the process.

    A run is a thread's; of runs within each other the inner one has paths of its own. What is left at the end stays where it is.
    """
    before = _RUN.set([])
    try:
        yield
    finally:
        _RUN.reset(before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _paths().append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths()[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trelliq_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize`, once nothing that is still to run reads it."""
    remove(df.sparkSession, df._trelliq_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path."""
    for paths in (_paths(), _MADE):
        if path in paths:
            paths.remove(path)
            break
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def made() -> int:
    """How many scratch paths there are now: a mark for :func:`clear`."""
    return len(_paths())


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch paths made after a mark: results of operators read theirs until they have been written or collected."""
    for path in [p for p in _paths()[since:] if p not in keep]:
        remove(spark, path)


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of up to ``rows`` rows whose texts have ``size`` bytes or less together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def keyed(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` with ``__trelliq_file`` and ``__trelliq_row``, which together name one row and stay the same in every scan.

    Rows of one Parquet scan under projections and filters have the place where they are stored. All others (joined, exploded,
    united, sampled, made up) are written to the shared folder first, so that each has a place of its own.
    """
    return _located(df if _is_stored(df) else materialize(df, name))


def _is_stored(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one stored row, and the same ones in every scan."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString() == "parquet"


def _located(df: DataFrame) -> DataFrame:
    return df.select("*", F.xxhash64("_metadata.file_path").alias("__trelliq_file"), F.col("_metadata.row_index").alias("__trelliq_row"))


ROW_KEY = ["__trelliq_file", "__trelliq_row"]


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
