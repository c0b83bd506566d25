"""WARC archives written and read by Spark.

Writing: a page is a row of text that holds a whole record; Spark's text sink puts the two line ends between records and its committer
makes files whole, on any file system, if executors are lost. Of pages with one payload the first has it and the others refer to it.

Reading: Spark cuts files anywhere, and a payload may hold what looks like a record. So each task emits for every line that might begin a
record where that record would end, which is where its successor must begin. Inside a block these links are followed at once, each
candidate to where its chain leaves the block; pointer jumping then finds which candidates the start of the file leads to, in as many
rounds as doublings reach the number of blocks of a file. A second scan reads the records from these places on, and what it has of
records that go over the end of a block is put together by a shuffle of those pieces alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, keyed, materialize, scratch

#: Fixed values of the format.
LINE, END = "\r\n", "\r\n\r\n"
VERSIONS = (b"WARC/1.0\r", b"WARC/1.1\r")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A record's header is no longer than this.
HEADER_BYTES = 1 << 20

#: What is known of the blocks is broadcast up to this many bytes, and joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20


# Writing


def _identifier(*parts: Column) -> Column:
    """A URN from 128 bits of a digest."""
    digest = F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 32)
    cut = lambda start, n: F.substring(digest, start, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 100) -> DataFrame:
    """(record string): a WARC record for every row of ``pages`` (page_id, url, html), without the line ends behind it.

    The payload is the html in UTF-8, null as empty, after a short HTTP header. Of equal payloads of ``least_bytes`` or more, the row with
    the smallest page_id (null last, then the first stored) is a response and the others revisit it: they have its record's id, the
    payload's digest and the HTTP header with the payload's length. Shorter payloads are all responses. A null url is about:blank, one
    with white space or control characters is percent-encoded. Repeated rows are records of their own. Other columns are not read.
    """
    rows = keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "warc-pages")
    rows = rows.withColumnRenamed("__trelliq_file", "file").withColumnRenamed("__trelliq_row", "row")
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    place = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "file", "row")
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    # Only payloads that occur again; the rest of the pages need no partner.
    again = materialize(groups.filter("n > 1").select("digest", "first"), "warc-groups")
    placed = rows.join(again, "digest", "left")
    revisits = F.coalesce(~place.eqNullSafe(F.col("first")) & F.col("first").isNotNull() & (F.col("bytes") >= least_bytes), F.lit(False))
    name = lambda at: _identifier(F.lit("page"), F.coalesce(F.col(f"{at}page_id").cast("string"), F.lit("")), F.col(f"{at}file").cast("string"), F.col(f"{at}row").cast("string"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.coalesce("url", F.lit("about:blank")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    field = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(LINE))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    return placed.withColumn("revisit", revisits).select(
        F.concat(
            F.lit(f"WARC/1.1{LINE}"),
            field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            field("WARC-Record-ID", name("")),
            field("WARC-Date", F.lit(date)),
            field("WARC-Target-URI", url),
            field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.coalesce(field("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
            F.when(F.col("revisit"), F.concat(field("WARC-Refers-To", name("first.")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
            field("Content-Type", F.lit("application/http;msgtype=response")),
            field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
            F.lit(LINE), http, body,
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Archives of ``pages`` in the folder ``path``, one for each partition; see ``records``. An empty table gives no archive, or an empty one."""
    records(pages, **options).write.option("lineSep", END).text(path)


# Where records begin


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, file_size, line): the lines of files, each in the block in which it begins; a block's lines are in order in one task."""
    meta = lambda c: F.col(f"_metadata.{c}")
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), meta("file_size").alias("file_size"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows that are of one block."""
    n = batch.num_rows
    if n:
        file, block = batch.column("file"), batch.column("block").to_numpy()
        other = (block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def _joined(lines: pa.Array) -> bytes:
    return b"\n".join([*lines.to_pylist(), b""])


def header_fields(header: bytes) -> dict[str, str]:
    """Fields of a header by their names in lower case; of a repeated field the last."""
    found = {}
    for line in header.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def _block_length(header: bytes) -> int | None:
    """Length of the block behind a header, if it is one."""
    length = header_fields(header).get("content-length", "")
    return int(length) if length.isascii() and length.isdigit() and len(length) < 19 else None


class _Block:
    """Candidates of a block, with places from its first line on."""

    def __init__(self, file: str, block: int, file_size: int):
        self.file, self.block, self.file_size = file, block, file_size
        self.size = 0
        self.head: bytes | None = b""  # up to the first empty line
        self.headed = False
        self.next: dict[int, int] = {}
        self.open: list[tuple[int, bytes]] = []  # candidates whose header has not ended yet

    def add(self, lines: pa.Array) -> None:
        starts = self.size + np.concatenate([[0], np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64) + 1)])
        blank = np.flatnonzero(pc.equal(lines, pa.scalar(b"\r", pa.binary())).to_numpy(zero_copy_only=False))
        first = int(blank[0]) + 1 if len(blank) else len(lines)
        if not self.headed or self.open:
            begin = _joined(lines.slice(0, first))
            if not self.headed:
                self.head = None if self.head is None or len(self.head) + len(begin) > HEADER_BYTES else self.head + begin
                self.headed = len(blank) > 0
            still, self.open = self.open, []
            for at, header in still:
                self._candidate(at, header + begin, len(blank) > 0)
        for i in np.flatnonzero(pc.is_in(lines, pa.array(VERSIONS, pa.binary())).to_numpy(zero_copy_only=False)).tolist():
            j = int(np.searchsorted(blank, i))
            end = int(blank[j]) + 1 if j < len(blank) else len(lines)
            self._candidate(int(starts[i]), _joined(lines.slice(i, end - i)), j < len(blank))
        self.size = int(starts[-1])

    def _candidate(self, at: int, header: bytes, ended: bool) -> None:
        if len(header) > HEADER_BYTES:
            return
        if not ended:
            self.open.append((at, header))
        elif (length := _block_length(header)) is not None:
            self.next[at] = at + len(header) + length + len(END)

    def rows(self) -> list[tuple]:
        """(file, block, file_size, size, head) of the block, and of each candidate its place, the last record of its chain here, and where that
        ends; or, of one whose header goes on in the next block, what there is of the header."""
        rows = [(self.file, self.block, self.file_size, self.size, self.head, None, None, None, None)]
        unfinished = dict(self.open)
        ends: dict[int, tuple[int, int]] = {}
        for at in sorted(self.next, reverse=True):
            to = self.next[at]
            if to >= self.size or to in unfinished:
                ends[at] = (at, to)
            elif to in ends:
                ends[at] = ends[to]
        rows += [(self.file, self.block, self.file_size, None, None, at, last, to, None) for at, (last, to) in ends.items()]
        return rows + [(self.file, self.block, self.file_size, None, None, at, at, None, header) for at, header in unfinished.items()]


_BLOCK_FIELDS = {"file": pa.string(), "block": pa.int64(), "file_size": pa.int64(), "size": pa.int64(), "head": pa.binary(), "at": pa.int64(), "last": pa.int64(), "to": pa.int64(), "header": pa.binary()}
_BLOCK_SCHEMA = "file string, block long, file_size long, size long, head binary, at long, last long, to long, header binary"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(block: _Block) -> pa.RecordBatch:
        columns = zip(*block.rows(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_FIELDS.values(), strict=True)], names=list(_BLOCK_FIELDS))

    now: _Block | None = None
    for batch in batches:
        for a, b in _runs(batch):
            file, block = batch.column("file")[a].as_py(), batch.column("block")[a].as_py()
            if now is None or (file, block) != (now.file, now.block):
                if now is not None:
                    yield out(now)
                now = _Block(file, block, batch.column("file_size")[a].as_py())
            now.add(batch.column("line").slice(a, b - a))
    if now is not None:
        yield out(now)


def _file_key(path: str) -> Column:
    return F.xxhash64(path)


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where records end whose header goes over the end of their block, from what the next blocks begin with."""
    for batch in batches:
        ends = []
        for at, header, heads in zip(*(batch.column(c).to_pylist() for c in ("at", "header", "heads")), strict=True):
            header = b"".join([header, *(h or b"" for h in heads)])
            cut = header.find(END.encode())
            length = _block_length(header[: cut + 4]) if cut >= 0 else None
            ends.append(None if length is None else at + cut + 4 + length + len(END))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), pa.array(ends, pa.int64())], names=["file", "at", "to"])


def _reached(nodes: DataFrame, rounds: int) -> DataFrame:
    """(file, at) of the nodes (file, at, to) to which the start of their file leads, by pointer jumping: ``rounds`` doublings of the jumps.

    Each round goes on from every node reached so far by one jump, and then makes each jump as long as two of it.
    """
    reached = nodes.filter("at = 0").select("file", "at")
    jumps = nodes.select("file", "at", "to")
    for i in range(rounds):
        # A node that a jump leads to is a candidate, and not just a place.
        landed = jumps.select("file", F.col("to").alias("at")).join(nodes.select("file", "at").distinct(), ["file", "at"], "left_semi").distinct()
        steps = jumps.join(landed.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi")
        reached = materialize(reached.union(reached.join(steps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        if i + 1 < rounds:
            far = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
            jumps = materialize(steps.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jumps")
    return reached


def block_starts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """For each block of the archives: where it begins in its file, its first record, the record that goes on from the block before and where
    that ends. (file, block, base, entry, owner, until), with a file's 64-bit hash for its path, here and in all tables on the way, whose rows
    are then a few numbers. Two paths with one hash are an error. A table in the shared folder.

    With ``strict`` a file whose chain of records does not lead from its start to its end is an error; else it is read as far as it leads.
    """
    found = materialize(_lines(spark, path).mapInArrow(_candidates, _BLOCK_SCHEMA), "warc-candidates")
    hashed = found.withColumns({"path": F.col("file"), "file": _file_key("file")})
    order = Window.partitionBy("file").orderBy("block")
    blocks = hashed.filter("at is null").select(
        "file", "path", "block", "file_size", "size",
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.collect_list(F.coalesce("head", F.lit(b""))).over(order.rowsBetween(1, 4)).alias("heads"),
    )
    blocks = materialize(blocks, "warc-blocks")
    sizes = blocks.groupBy("file").agg(F.min("path").alias("path"), F.max("path").alias("other"), F.sum("size").alias("sum"), F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("n"))
    # The last line need not end in a line feed, which is counted with every line.
    odd = sizes.filter("path != other or sum != file_size and sum != file_size + 1").first()
    if odd is not None:
        raise ValueError(f"{odd.path}: lines of {odd.sum} bytes in a file of {odd.file_size}" if odd.path == odd.other else f"{odd.path} and {odd.other} have one hash")
    places = hashed.filter("at is not null").select("file", "block", "at", "last", "to", "header").join(blocks.select("file", "block", "base", "heads"), ["file", "block"])
    absolute = lambda c: (F.col("base") + F.col(c)).alias(c)
    inside = places.filter("header is null").select("file", "block", absolute("at"), absolute("last"), absolute("to"))
    cut = places.filter("header is not null").select("file", "block", absolute("at"), "header", "heads")
    ends = cut.select("file", "at", "header", "heads").mapInArrow(_continued, "file long, at long, to long").filter("to is not null")
    over = cut.select("file", "block", "at").join(ends, ["file", "at"]).select("file", "block", "at", F.col("at").alias("last"), "to")
    nodes = materialize(inside.union(over), "warc-nodes")
    longest = sizes.agg(F.max("n")).first()[0] or 1
    # A chain has a jump out of each block at most, and one more to a header that is cut by its end.
    reached = _reached(nodes, (2 * longest - 1).bit_length() if longest > 1 else 0)
    chain = materialize(nodes.join(reached, ["file", "at"]), "warc-chain")
    if strict:
        ended = sizes.filter("file_size > 0").join(chain.groupBy("file").agg(F.max("to").alias("end")), "file", "left")
        broken = ended.filter("end is null or end != file_size").select("path", "end", "file_size").first()
        if broken is not None:
            raise ValueError(f"{broken.path}: records lead to {broken.end} of {broken.file_size} bytes")
    # Of a block's nodes on the chain the last is the record that leaves it.
    entries = chain.groupBy("file", "block").agg(F.min("at").alias("entry"), F.max(F.struct("last", "to")).alias("leaves"))
    before = F.last("leaves", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "base").join(entries, ["file", "block"], "left").withColumn("before", before)
    out = materialize(starts.select("file", "block", "base", "entry", F.col("before.last").alias("owner"), F.col("before.to").alias("until")), "warc-starts")
    for done in (found, blocks, nodes, chain):
        discard(done)
    return out


# Reading

_RECORD = "file string, offset long, headers map<string,string>, http map<string,string>, payload binary"
_TEXT_MAP = pa.map_(pa.string(), pa.string())


class _Rows:
    """Parsed records, given out by bytes."""

    def __init__(self, most: int = 8 << 20):
        self.rows, self.held, self.most = [], 0, most

    def add(self, file: str, offset: int, raw: bytes) -> None:
        """A record without the line ends behind it; one of an HTTP message is split into that message's fields and payload."""
        header, _, block = raw.partition(END.encode())
        headers, http, payload = header_fields(header), None, block
        if headers.get("content-type", "").lower().startswith("application/http"):
            message, _, payload = block.partition(END.encode())
            http = header_fields(message)
        self.rows.append((file, offset, list(headers.items()), None if http is None else list(http.items()), payload))
        self.held += len(raw)

    def taken(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_ or self.held >= self.most):
            types = [pa.string(), pa.int64(), _TEXT_MAP, _TEXT_MAP, pa.large_binary() if self.held >= 1 << 31 else pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "headers", "http", "payload"])


def _read(pieces: bool):
    """Records that lie in one block; or else the pieces of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        key = None
        held = bytearray()
        at = entry = owner = until = None  # place of held's first byte

        def piece(offset: int, start: int, raw: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([offset], pa.int64()), pa.array([start], pa.int64()), pa.array([bytes(raw)], pa.binary())], names=["file", "offset", "start", "raw"])

        def close() -> Iterator[pa.RecordBatch]:
            if pieces and held:
                if entry is not None and at >= entry:
                    yield piece(at, at, held)
                elif owner is not None and at < until:
                    yield piece(owner, at, held[: until - at])

        for batch in batches:
            for a, b in _runs(batch):
                if (batch.column("file")[a].as_py(), batch.column("block")[a].as_py()) != key:
                    yield from close()
                    key = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
                    at, entry, owner, until = (batch.column(c)[a].as_py() for c in ("base", "entry", "owner", "until"))
                    held = bytearray()
                held += _joined(batch.column("line").slice(a, b - a))
                used = 0
                if entry is None or at < entry:
                    # What the record of an earlier block still needs.
                    stop = len(held) if entry is None else min(len(held), entry - at)
                    if pieces and owner is not None and at < until and stop:
                        yield piece(owner, at, held[: min(stop, until - at)])
                    used = stop
                if entry is not None and at + used >= entry:
                    while (cut := held.find(END.encode(), used)) >= 0:
                        length = _block_length(bytes(held[used : cut + 4]))
                        if length is None or len(held) < cut + 4 + length + len(END):
                            break
                        if not pieces:
                            rows.add(key[0], at + used, bytes(held[used : cut + 4 + length]))
                            yield from rows.taken()
                        used = cut + 4 + length + len(END)
                del held[:used]
                at += used
        yield from close()
        if not pieces:
            yield from rows.taken(True)

    return run


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from pieces; one that its file does not hold to the end is left out."""
    rows = _Rows()
    for batch in batches:
        for file, offset, raw in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("raw"), strict=True):
            raw = b"".join(x["raw"] for x in sorted(raw.as_py(), key=lambda x: x["start"]))
            cut = raw.find(END.encode())
            length = _block_length(raw[: cut + 4]) if cut >= 0 else None
            if length is not None and len(raw) >= cut + 4 + length:
                rows.add(file, offset, raw[: cut + 4 + length])
            yield from rows.taken()
    yield from rows.taken(True)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, offset, headers, http, payload) of every record of the archives at ``path``, uncompressed files of any writer.

    Names of fields are in lower case. ``payload`` is what follows the header of an HTTP message, or else the whole block. Archives may be of
    any size and are read by blocks; a payload is one value in a task's memory. What looks like a record inside a payload is not one.
    See ``block_starts`` for ``strict``.
    """
    starts = block_starts(spark, path, strict)
    starts = starts.withColumnRenamed("file", "key")
    lines = _lines(spark, path).drop("file_size").withColumn("key", _file_key("file"))
    if 64 * starts.count() <= BROADCAST_BYTES:
        known = lines.join(F.broadcast(starts), ["key", "block"])
    else:
        known = lines.withColumn("n", F.monotonically_increasing_id()).join(starts, ["key", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "n")
    known = known.select("file", "block", "base", "entry", "owner", "until", "line")
    whole = known.mapInArrow(_read(False), _RECORD)
    pieces = known.mapInArrow(_read(True), "file string, offset long, start long, raw binary")
    over = pieces.groupBy("file", "offset").agg(F.collect_list(F.struct("start", "raw")).alias("raw")).mapInArrow(_parsed, _RECORD)
    return whole.union(over)


def page_records(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits among records from ``read_archives``.

    A response's length and digest are those of the payload that was read, a revisit's those of the response that it refers to; if the
    archives lack that one, or its payload is not what the revisit names, ``refers_to``, length and digest are null.
    """
    field = lambda c: F.col("headers")[c]
    pages = read.filter(field("warc-type").isin("response", "revisit")).select(
        field("warc-page-id").cast("long").alias("page_id"), field("warc-type").alias("record_type"), field("warc-record-id").alias("id"), field("warc-refers-to").alias("refers"),
        F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.substring_index(field("warc-payload-digest"), ":", -1).alias("named"),
    )
    pages = materialize(pages, "warc-pages-read")
    # Only responses that are referred to have to meet their revisits.
    referred = pages.filter("record_type = 'revisit'").select(F.col("refers").alias("id")).distinct()
    responses = pages.filter("record_type = 'response'").join(referred, "id", "left_semi")
    responses = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("to"), F.col("bytes").alias("to_bytes"), F.col("digest").alias("named"))
    revisits = pages.filter("record_type = 'revisit'").drop("bytes", "digest").join(responses, ["refers", "named"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = pages.filter("record_type = 'response'").select("page_id", "bytes", "digest", "record_type", F.lit(None).cast("long")).toDF(*columns)
    other = revisits.select("page_id", "to_bytes", F.when(F.col("to_bytes").isNotNull(), F.col("named")), "record_type", "to").toDF(*columns)
    return first.union(other)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` (page_id, url, html, ...) hold once they are written and read back; see ``records`` and ``page_records``.

    A row for each row of ``pages``, null and repeated page_ids included; an empty table gives an empty result.
    """
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return page_records(read_archives(pages.sparkSession, path))
