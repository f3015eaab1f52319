"""WARC archives: written through Spark's text sink, read back as a byte stream, and assembled into
one nested row per capture.

The end of a WARC record, two empty lines, is the text sink's and source's line separator. Content
lengths decide where a record ends, whatever its payload contains, so a file has to be read from its
start: files that Spark cuts into ranges (plain ones, bzip2) are put together again, dealt by file and
sorted by place. A task holds one record at a time. Files of single gzip members for each record, as
other tools write them, can be read as well. A record whose length is unreadable or that the file's end
cuts off is a row that says so in ``defect``; after the former, reading goes on at the next record.

A transaction is a response (or a revisit, whose payload an earlier response has) with the request
and metadata records that name it in WARC-Concurrent-To. They meet in one group by that name; revisits
are then joined with the response they refer to.

Rows: a null payload is an empty one, a null url leaves out the target, ids may be null. Every row is a
capture of its own, also rows that share an id, and equal rows: names are made of id, url, payload and
a number among equal rows. Records that name no known capture are left out. Payloads are compared by
SHA-256. Columns besides the three that are named play no part. Empty tables give empty archives and no
capture.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.scratch import stored

GAP = "\r\n\r\n"
# Fixed: values of the WARC 1.1 format.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 100


def plan_records(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
    payload_column: str = "html", least: int = LEAST_BYTES,
) -> DataFrame:
    """(id, url, payload, digest, name, refers_to): the last is the name of a response with an equal
    payload of at least ``least`` bytes and the smallest id, if that is another one."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # one narrow table says which rows are equal, and which response each payload has
    counts = stored(rows.groupBy("id", F.xxhash64("url").alias("place"), "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("url").alias("url"), F.max(F.octet_length("payload")).alias("size"),
    ), "page-counts")
    # written, so that the optimizer knows how few these are
    equal = stored(counts.where("n > 1").select(F.struct("id", "place", "digest").alias("same"), "n"), "equal-pages")
    key = F.struct("id", F.xxhash64("url").alias("place"), "digest")
    rows = rows.join(equal, key.eqNullSafe(F.col("same")), "left")
    # of equal rows one stands for all
    once = rows.where("n IS NOT NULL").groupBy("same").agg(
        F.first("id").alias("id"), F.first("url").alias("url"), F.first("payload").alias("payload"),
        F.first("digest").alias("digest"), F.first("n").alias("n"))
    rows = rows.where("n IS NULL").select("id", "url", "payload", "digest", F.lit(1).cast("long").alias("number")) \
        .unionByName(once.select("id", "url", "payload", "digest", F.explode(F.sequence(F.lit(1), "n")).alias("number")))

    def name(number):
        return _name(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("none")), "digest",
                                 F.xxhash64("url").cast("string"), number.cast("string")), "response")

    known = F.when(F.col("id").isNotNull(), F.struct("id", name(F.lit(1)).alias("name")))
    first = counts.where(F.col("size") >= least).groupBy("digest").agg(
        F.min(known).alias("first"), F.sum("n").alias("copies"),
    ).where("copies > 1 AND first IS NOT NULL").drop("copies")
    rows = rows.join(first, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return rows.select(
        "id", "url", "payload", "digest", name(F.col("number")).alias("name"),
        F.when(other, F.col("first.name")).alias("refers_to"))


def _name(own: Column, kind: str) -> Column:
    """A record's name: a UUID made from its page and kind."""
    h = F.md5(F.concat(own, F.lit(":" + kind)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, name: Column, block: Column, more: list[tuple[str, Column | str]]) -> Column:
    fields = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in more]
    return F.concat(F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), name), F.lit(f"WARC-Date: {DATE}"), *fields,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ), F.lit(GAP), block)


def write_archives(records: DataFrame, path: str) -> None:
    """From ``plan_records``: request, response or revisit, and metadata records of each row, side by
    side in gzip files below the path."""
    # a header's value is one line
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    uri = ("WARC-Target-URI", target)
    host = F.regexp_extract(target, r"^[^:]*://([^/?#]*)", 1)
    place = F.regexp_extract(target, r"^[^:]*://[^/?#]*([^#]*)", 1)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    beside = ("WARC-Concurrent-To", F.col("name"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(GAP))
    answer = ("Content-Type", "application/http;msgtype=response")
    response = _record("response", F.col("name"), F.concat(http, "payload"), [uri, digest, answer])
    revisit = _record("revisit", F.col("name"), http, [
        uri, digest, ("WARC-Refers-To", F.col("refers_to")), ("WARC-Profile", IDENTICAL), answer])
    request = _record(
        "request", _name(F.col("name"), "request"),
        F.concat(F.lit("GET "), F.coalesce(F.when(place != "", place), F.lit("/")),
                 F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(GAP)),
        [uri, beside, ("Content-Type", "application/http;msgtype=request")])
    metadata = _record(
        "metadata", _name(F.col("name"), "metadata"),
        F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")),
        [uri, beside, ("Content-Type", "application/warc-fields")])
    main = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    rows = records.select(F.explode(F.array(request, main, metadata)).alias("value"))
    rows.write.text(path, compression="gzip", lineSep=GAP)


FIELDS = {
    "record_id": "WARC-Record-ID", "type": "WARC-Type", "concurrent_to": "WARC-Concurrent-To",
    "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "date": "WARC-Date",
    "digest": "WARC-Payload-Digest",
}


def _parsed(head: bytes, block: bytes, payload: bool) -> dict:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    row = {name: fields.get(field.lower()) for name, field in FIELDS.items()}
    body = block
    if fields.get("content-type", "").startswith("application/http"):
        row["http"], _, body = block.partition(GAP.encode())
    row["payload_bytes"] = len(body)
    row["payload_sha256"] = hashlib.sha256(body).hexdigest()
    keep = payload or row["type"] not in ("response", "revisit")
    return row | {"payload": body if keep else None}


class _Stream:
    """Records of one file, from its pieces between gaps in their order."""

    gap = GAP.encode()

    def __init__(self, payload: bool):
        self.payload, self.parts, self.size = payload, [], 0
        self.head, self.length, self.lost = None, 0, False

    def _keep(self, data: bytes) -> None:
        self.parts, self.size = ([data], len(data)) if data else ([], 0)

    def add(self, piece: bytes) -> Iterator[dict]:
        if self.lost and not piece.lstrip(b"\r\n").startswith(b"WARC/"):
            return
        self.lost = False
        self.parts += [piece, self.gap]
        self.size += len(piece) + len(self.gap)
        while True:
            if self.head is None:
                data = b"".join(self.parts)
                at = data.find(self.gap)
                head = data[:at].lstrip(b"\r\n") if at >= 0 else b""
                self._keep(data[at + len(self.gap):] if at >= 0 else data)
                if not head:
                    if at < 0 or not self.size:
                        return
                    continue
                length = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")
                          if x.lower().startswith(b"content-length:")]
                if length and not length[0].isdigit():
                    yield _parsed(head, b"", self.payload) | {"defect": "length"}
                    rest, self.lost = b"".join(self.parts), True
                    self._keep(b"")
                    if rest:
                        yield from self.add(rest.removesuffix(self.gap))
                    return
                self.head, self.length = head, int(length[0]) if length else 0
            if self.size < self.length + len(self.gap):
                return
            data = b"".join(self.parts)
            yield _parsed(self.head, data[: self.length], self.payload)
            self._keep(data[self.length + len(self.gap):])
            self.head = None
            if not self.size:
                return

    def end(self) -> Iterator[dict]:
        """What the file's end cut off."""
        if self.head is not None:
            block = b"".join(self.parts).removesuffix(self.gap)
            yield _parsed(self.head, block, self.payload) | {"defect": "truncated"}


def _records(payload: bool):
    schema = pa.schema([(n, pa.string()) for n in FIELDS] + [
        ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()), ("defect", pa.string())])

    def run(batches):
        file, stream, found, held = None, None, [], 0
        for batch in batches:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value")):
                if name != file:
                    if stream is not None:
                        found += stream.end()
                    file, stream = name, _Stream(payload)
                for row in stream.add(value.as_buffer().to_pybytes()):
                    found.append(row)
                    held += len(row["payload"] or b"")
                if held > 1 << 22 or len(found) >= 4096:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, held = [], 0
        if stream is not None:
            found += stream.end()
        yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


# Files of other endings are read from their start by one task as they are.
WHOLE = (".gz", ".zst", ".lz4", ".snappy", ".deflate")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record: its main fields, http head, payload (null for responses if not asked for),
    the payload's size and digest as read, and ``defect`` (``length``, ``truncated`` or null)."""
    text = spark.read.text(path, lineSep=GAP)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value"))
    if not all(file.endswith(WHOLE) for file in text.inputFiles()):
        # Spark may have cut files into ranges, each of which holds pieces in their order
        pieces = pieces.repartition("file").sortWithinPartitions("file", "start", "place")
    columns = ", ".join(f"{n} string" for n in FIELDS)
    return pieces.select("file", "value").mapInArrow(
        _records(payload),
        f"{columns}, http binary, payload binary, payload_bytes long, payload_sha256 string, defect string")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``record_id``, ``type``, ``uri``, ``date``, ``payload``, ``payload_bytes``,
    ``payload_sha256`` (both of the full payload, also for revisits), ``sound`` (whether the payload
    has the digest that its record states), ``request`` and ``metadata`` (structs, null if there is
    none; of several the one whose name sorts first), ``refers_to`` (name and metadata of the response
    that a revisit refers to)."""
    def least(kinds, *columns):
        return F.min(F.when(F.col("type").isin(*kinds), F.struct(*columns)))

    whole = ["type", "uri", "date", "refers_to", "digest", "payload", "payload_bytes", "payload_sha256"]
    main = ("response", "revisit")
    name = F.when(F.col("type").isin(*main), F.col("record_id")).otherwise(F.col("concurrent_to"))
    captures = (
        records.where("defect IS NULL").withColumn("capture", name).where("capture IS NOT NULL")
        .groupBy("capture").agg(
            least(main, *whole).alias("c"),
            least(["request"], "record_id", "http", "payload").alias("request"),
            least(["metadata"], "record_id", "http", "payload").alias("metadata"))
        .where("c IS NOT NULL").select(F.col("capture").alias("record_id"), "c.*", "request", "metadata")
    )
    # written once, so that archives are parsed once, and the join with a response that very many
    # revisits refer to can be split
    captures = stored(captures, "captures")
    # of a response its revisits need the payload as well, if it was read
    original = captures.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.struct(
            "record_id", "metadata", "payload", "payload_bytes", "payload_sha256").alias("original"))
    joined = captures.join(original, "refers_to", "left")

    def full(column):
        return F.when(F.col("original").isNotNull(), F.col("original." + column)).otherwise(F.col(column))

    return joined.select(
        "record_id", "type", "uri", "date", full("payload").alias("payload"),
        full("payload_bytes").alias("payload_bytes"), full("payload_sha256").alias("payload_sha256"),
        (F.concat(F.lit("sha256:"), full("payload_sha256")) == F.col("digest")).alias("sound"),
        "request", "metadata",
        F.when(F.col("original").isNotNull(), F.struct("original.record_id", "original.metadata"))
        .alias("refers_to"),
    )
