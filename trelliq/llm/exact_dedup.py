"""Exact deduplication as a stateful stream.

Every arriving row is reduced to (digest, doc_id, locator). A streaming aggregation keyed by the digest keeps, in RocksDB
on the executors' disks and without expiry, how many rows had the digest and the largest (doc_id, locator) among them.
No text enters the state. Digests seen more than once are hits: the full bytes of all their rows are compared before
the group counts as equal, and digests under which texts differ are resolved by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ROW_KEY, keyed, materialize, remove, scratch, slices

#: State on the executors' disks, in files that take no more room than they fill.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Digests of repeated texts are broadcast only up to this many bytes; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def _normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def _digests(digest_bytes: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts = [_normalised(t) for t in some.column("text").to_pylist()]
                digest = pa.array([hashlib.sha256(t).digest()[:digest_bytes] for t in texts], pa.binary())
                columns = {"digest": digest} | {c: some.column(c) for c in ("doc_id", *ROW_KEY)}
                if with_text:
                    columns["norm"] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _stream_state(arrivals: DataFrame, path: str, files_per_batch: int) -> DataFrame:
    """(digest, n, keep) for each digest: the state of a stream over ``arrivals`` after its last row."""
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    out, checkpoint = scratch(spark, "dedup-state"), scratch(spark, "dedup-checkpoint")
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = (
            spark.readStream.schema(arrivals.schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(path)
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", *ROW_KEY)).alias("keep"))
        )
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Counts and identifiers only grow, so the last state of a digest is the largest that any batch wrote.
    schema = arrivals.select("digest", F.lit(1).cast("long").alias("n"), F.struct("doc_id", *ROW_KEY).alias("keep")).schema
    changes = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(out) if _has_files(spark, out) else spark.createDataFrame([], schema)
    state = materialize(changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep")), "dedup-kept")
    remove(spark, checkpoint)
    remove(spark, out)
    return state


def _has_files(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deduplicate(docs: DataFrame, files_per_batch: int = 1000, digest_bytes: int = 32) -> DataFrame:
    """Group rows of ``docs`` (doc_id, text, ...) whose texts are equal after lower-casing A-Z.

    Returns one row per row of ``docs``: ``__trelliq_file``, ``__trelliq_row`` (the row's place), doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty, and so equals it. A null doc_id is smaller than any other. Of rows that repeat both doc_id
    and text exactly one is kept. An empty table gives an empty result. Other columns are neither read nor returned,
    whatever their names. ``digest_bytes`` shortens the digest (tests force collisions with it).
    """
    rows = keyed(docs.select("doc_id", "text"), "dedup-rows")
    plain = "digest binary, doc_id long, __trelliq_file long, __trelliq_row long"
    spark = docs.sparkSession
    path = scratch(spark, "dedup-arrivals")
    rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_digests(digest_bytes, False), plain).write.parquet(path)
    arrivals = spark.read.schema(plain).parquet(path)
    state = _stream_state(arrivals, path, files_per_batch)

    # Full bytes on hits. Within a task and then across tasks one smallest and one largest text per digest travel on.
    hits = state.filter("n > 1").select("digest")
    if hits.count() * (digest_bytes + 32) <= BROADCAST_BYTES:
        hits = F.broadcast(hits)
    texts = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_digests(digest_bytes, True), plain + ", norm binary")
    hit_texts = texts.join(hits, "digest", "left_semi")
    differing = materialize(hit_texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo != hi").select("digest"), "dedup-differing")

    if differing.isEmpty():
        return _decide(arrivals.join(state, "digest"))
    clash = texts.join(differing, "digest", "left_semi")
    groups = clash.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", *ROW_KEY)).alias("keep"))
    resolved = clash.join(groups, ["digest", "norm"]).drop("norm")
    sure = arrivals.join(differing, "digest", "left_anti").join(state, "digest")
    return _decide(sure).unionByName(_decide(resolved))


def _decide(joined: DataFrame) -> DataFrame:
    same: Column = F.lit(True)
    for c in ("doc_id", *ROW_KEY):
        same = same & F.col(c).eqNullSafe(F.col(f"keep.{c}"))
    return joined.select(*ROW_KEY, "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), "digest")


def keep_first_rows(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat another's text (A-Z lower-cased); columns as they were.

    The row with the largest doc_id stays, of several such rows one, and one with a null doc_id only where all are null. Null and
    empty texts are equal. An empty table stays empty.
    """
    rows = keyed(docs, "dedup-rows")
    kept = deduplicate(rows.drop(*ROW_KEY)).filter("kept").select(*ROW_KEY)
    return rows.join(kept, ROW_KEY, "left_semi").drop(*ROW_KEY)
