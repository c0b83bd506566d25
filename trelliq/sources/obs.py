"""Observation tables: one row per (trial_id, t), and how kernels walk over whole trials."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OBS = "trial_id long, t int, y array<double>, u array<double>, w double"


def to_obs(df: DataFrame, trial: str, order: Sequence[str], y: Sequence[str], u: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """OBS rows from any table: trials by ``trial``, time steps 1, 2, ... in the order of ``order``."""
    number = F.row_number().over(Window.partitionBy(trial).orderBy(*order)).cast("int")
    cast = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(
        F.col(trial).cast("long").alias("trial_id"), number.alias("t"), cast(y).alias("y"),
        (cast(u) if u else F.lit(None).cast("array<double>")).alias("u"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"),
    )


def check_obs(obs: DataFrame) -> None:
    """Raise if an observation is null or NaN, or a trial's steps are not 1..T."""
    bad = F.col("y").isNull() | F.exists("y", lambda v: v.isNull() | F.isnan(v))
    if not obs.filter(bad).isEmpty():
        raise ValueError("null or NaN observations")
    steps = obs.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.countDistinct("t").alias("d"))
    if not steps.filter("lo != 1 or hi != n or d != n").isEmpty():
        raise ValueError("time steps must be 1..T in each trial")


def same_type(df: DataFrame, *columns: str) -> bool:
    """Whether columns hold numbers of one type, alone or in arrays; known from the schema, so nothing is read."""

    def innermost(t: T.DataType) -> T.DataType:
        return innermost(t.elementType) if isinstance(t, T.ArrayType) else t

    return len({innermost(df.schema[c].dataType) for c in columns}) <= 1


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """``df`` with driver rows at its end."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))


def by_trial(obs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One shuffle that brings each trial's rows together in order; persist the result before iterating over it."""
    n = [partitions] if partitions else []
    return obs.repartition(*n, "trial_id").sortWithinPartitions("trial_id", "t")


def kept(df: DataFrame, round_: int, every: int = 5) -> DataFrame:
    """``df`` persisted, and each ``every`` rounds of an iteration also written to the checkpoint folder, if the session has one.

    A lost executor's partitions are then computed again from the last round that was written and not from the first. The files stay
    until the folder is cleared, or go with the table if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    df = df.persist()
    if round_ % every != every - 1 or not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df
    written = df.checkpoint()
    df.unpersist()
    return written


class ObservationError(ValueError):
    """Observations that no model can be fitted to, with how many there are of each kind."""


#: What makes a trial unfit, in the order of the counts of ``faults``.
FAULTS = ("rows without trial_id", "steps with a null or NaN observation", "steps with a null, NaN or negative weight", "steps with some null or NaN inputs", "steps that do not follow the one before by 1")


def faults(p: pd.DataFrame) -> np.ndarray:
    """How often a trial has each of ``FAULTS``. Inputs may be null in all steps alike; columns that are not there have no faults."""
    out = np.zeros(len(FAULTS))

    def bad(column: str) -> int:
        values, missing = p[column], p[column].isna().to_numpy()
        if column == "u" and missing.all():
            return 0
        known = values.to_numpy()[~missing]
        if len({len(v) for v in known}) > 1:
            raise ObservationError(f"{column} of different lengths in trial {p['trial_id'].iat[0]}")
        return int(missing.sum()) + (int((~np.isfinite(np.stack(known).astype(float))).any(axis=1).sum()) if len(known) else 0)

    if "y" in p:
        out[1] = bad("y")
    if "w" in p and p["w"].dtype != object:
        w = p["w"].to_numpy(float)
        out[2] = (~(np.isfinite(w) & (w >= 0))).sum()
    if "u" in p:
        out[3] = bad("u")
    if "t" in p:
        t = p["t"].to_numpy(float)
        out[4] = (t[:1] != 1).sum() + (np.diff(t) != 1).sum()
    return out


def refuse(counts: np.ndarray) -> None:
    """Raise if there are any faults."""
    if counts.any():
        raise ObservationError("; ".join(f"{int(n)} {what}" for n, what in zip(counts, FAULTS, strict=True) if n))


def sound(some: list[pd.DataFrame], counts: np.ndarray) -> list[pd.DataFrame]:
    """The trials without faults; those of the others are added to ``counts``."""
    found = [faults(p) for p in some]
    for f in found:
        counts += f
    return [p for p, f in zip(some, found, strict=True) if not f.any()]


def trials(batches: Iterator[pd.DataFrame], chunk: int = 256, cells: int = 1 << 18, counts: np.ndarray | None = None) -> Iterator[list[pd.DataFrame]]:
    """Lists of whole trials from a partition that is sorted by (trial_id, t), in whatever batches it comes.

    A list has at most ``chunk`` trials, and padded to the longest of them at most ``cells`` steps, unless it is one longer trial.
    Rows without trial_id belong to no trial: they are left out and added to ``counts``, or an error without it.
    """
    held: list[pd.DataFrame] = []
    done: list[pd.DataFrame] = []
    longest = 0

    def close() -> Iterator[list[pd.DataFrame]]:
        nonlocal held, done, longest
        trial = held[0] if len(held) == 1 else pd.concat(held)
        held = []
        if done and (len(done) >= chunk or (len(done) + 1) * max(longest, len(trial)) > cells):
            yield done
            done, longest = [], 0
        done.append(trial)
        longest = max(longest, len(trial))

    for pdf in batches:
        nameless = pdf["trial_id"].isna()
        if nameless.any():
            if counts is None:
                raise ObservationError(f"{int(nameless.sum())} {FAULTS[0]}")
            counts[0] += int(nameless.sum())
            pdf = pdf[~nameless]
        if pdf.empty:
            continue
        # Nulls make pandas read ids as floating point numbers.
        ids = pdf["trial_id"].to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = pdf.iloc[a:b]
            if held and held[-1]["trial_id"].iat[0] != part["trial_id"].iat[0]:
                yield from close()
            held.append(part)
    if held:
        yield from close()
    if done:
        yield done


def matrix(pdf: pd.DataFrame, column: str) -> np.ndarray | None:
    """(T, width) values of an array column; None if the column is null throughout. Single nulls and NaN are an error."""
    values = pdf[column].to_numpy()
    missing = pdf[column].isna().to_numpy()
    if len(values) and missing.all() and column != "y":
        return None
    out, what = np.empty((0, 0)), "null"
    if len(values) and not missing.any():
        out, what = np.stack(values).astype(float), "NaN"
        missing = np.isnan(out).any(axis=1)
    if missing.any():
        i = int(missing.argmax())
        raise ObservationError(f"{what} {column} in trial {pdf['trial_id'].iat[i]} at step {pdf['t'].iat[i] if 't' in pdf else '?'}")
    return out


def numbers(df: DataFrame, known: Column | None = None) -> DataFrame:
    """What comes from pandas, where a NaN leaves as null, with its NaN again in doubles and in arrays of them; of rows that are ``known``."""
    cover = {"double": lambda c: F.coalesce(c, F.lit(math.nan)), "array<double>": lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(math.nan)))}
    known = F.lit(True) if known is None else known
    return df.select(*[F.when(known, cover[t](F.col(c))).otherwise(F.col(c)).alias(c) if t in cover else F.col(c) for c, t in df.dtypes])


def finite(df: DataFrame, *columns: str) -> bool:
    """Whether no NaN and no infinity is in any of some array columns; nulls are not looked at."""
    return df.filter(F.greatest(*[F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == math.inf)) for c in columns], F.lit(False))).isEmpty()


#: Numbers of a task's vector that travel in one row, and up to how many numbers they are added up one by one.
BLOCK, NARROW = 8192, 1 << 16

#: A task's vector, in blocks.
VECTOR = "i int, v array<double>"


def vector_batch(v: np.ndarray) -> pa.RecordBatch:
    """Rows of VECTOR. Not by way of pandas, where a NaN becomes a null and sums leave it out."""
    v = np.asarray(v, float)
    return _blocks({i: v[i * BLOCK : (i + 1) * BLOCK] for i in range(-(-len(v) // BLOCK))})


def _blocks(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, blocks.values())])
    values = pa.array(np.concatenate([*blocks.values(), np.empty(0)]), pa.float64(), from_pandas=False)
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["i", "v"])


def _added_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
            v = v.values.to_numpy(zero_copy_only=False)
            sums[i] = sums[i] + v if i in sums else v.copy()
    yield _blocks(sums)


def added(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' vectors (rows of VECTOR); a NaN stays one.

    Long vectors are added up block by block where their rows meet: those of a sixteenth of the tasks first, and then their sums.
    """
    out = np.zeros(width)
    if width <= NARROW:
        each = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy((F.col("i") * BLOCK + F.col("j")).alias("at")).agg(F.sum("x").alias("x"))
        for at, x in each.collect():
            out[at] = x
        return out
    blocks = -(-width // BLOCK)
    some = parts.repartition(min(16 * blocks, 512), "i", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(_added_blocks, VECTOR)
    for i, v in some.repartition(min(blocks, 128), "i").mapInArrow(_added_blocks, VECTOR).toLocalIterator():
        out[i * BLOCK : i * BLOCK + len(v)] = v
    return out


def summed(arranged: DataFrame, statistics: Callable[[pd.DataFrame], np.ndarray], width: int, check: bool = True) -> np.ndarray:
    """Sum over all trials of a vector of statistics: summed in each task, then across tasks, so one vector reaches the driver.

    In the same pass trials are looked through for ``FAULTS``; any is an ``ObservationError``, and the sums are not used. ``check`` turns
    that off for a table that was looked through before.
    """
    n = len(FAULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, out = np.zeros(n), np.zeros(width)
        for some in trials((b.to_pandas() for b in batches), counts=counts):
            for p in sound(some, counts) if check else some:
                out += statistics(p)
        yield vector_batch(np.concatenate([counts, out]))

    out = added(arranged.mapInArrow(run, VECTOR), n + width)
    refuse(out[:n])
    return out[n:]


def refuse_faults(arranged: DataFrame) -> None:
    """Raise ``ObservationError`` if a trial of a table from ``by_trial`` has any of ``FAULTS``: one pass, for kernels that do more than sum."""
    summed(arranged, lambda p: np.empty(0), 0)
