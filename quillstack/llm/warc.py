"""WARC archives: writing captures, and assembling transactions from what is read back.

A capture is three records: the request, the response (or, for a payload seen before, a revisit that
names the response), and metadata.  Request and metadata name the response in WARC-Concurrent-To.
Reading groups records by that identifier into one nested row a capture.  Archives of other writers
may name each other in another order, or in chains: for these ``linked`` makes the identifiers of all
records that hang together one, by connected components.

Archives are gzip files of about ``archive_bytes`` of payload, written by Spark's own writer: each
record ends in two line ends, which are the writer's line separator.  So the commit protocol covers
them, and a task that is run again leaves nothing double.  Reading goes by Content-Length, so a
payload may hold anything, record headers too.

A payload of at least ``least_shared`` bytes is stored once, with the least page id that has it.  To
find that id, only digests are shuffled, and added up by digest before; the pages themselves move
once, by page id.

Defined results: a null payload is empty; payloads below the limit are responses all; repeated page
ids each keep their row, and rows that tie for the least id with equal payloads are responses all; a
null page id is greater than any other and, if it stands alone, refers to nothing; of records of other
writers, a missing record id is made from the file and place, a missing or unknown digest leaves
``intact`` null, and else ``intact`` tells whether it is that of the payload; headers that are not UTF-8
are taken as Latin-1; of repeated headers all of WARC-Concurrent-To count, and the first of any other;
metadata without our notes has nulls for them; control characters and
spaces of a URL are percent-encoded in headers, and a null URL is empty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path
from .components import components

ARCHIVE_BYTES, LEAST_SHARED = 8 << 20, 100
END, STOP = "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _header_value(c: Column) -> Column:
    """Text that stays on its line: ASCII controls and space in percent form."""
    safe = c = F.coalesce(c.cast("string"), F.lit(""))
    for code in [*range(33), 127]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(c.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(c)


def _record(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it."""
    head = [F.lit(f"WARC/1.1{END}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind]
    for name, value in [("WARC-Date", F.lit(DATE)), *fields]:
        head.append(F.coalesce(F.concat(F.lit(f"{END}{name}: "), value), F.lit("")))
    return F.concat(*head, F.lit(f"{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(STOP), block)


def first_holders(pages: DataFrame, least_shared: int = LEAST_SHARED, parts: int = 1) -> DataFrame:
    """``pages(id, url, payload)`` with ``digest``, ``bytes``, ``page`` and ``first``.

    ``first`` is the least id with the same payload, where that is another; ``page`` is the id as text.
    The result is dealt into ``parts`` by page and digest, which is also the join's partitioning.
    """
    page, digest = F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("page"), F.sha2("payload", 256).alias("digest")
    size = F.octet_length("payload").cast("long").alias("bytes")
    light = pages.select("id", page, digest, size).filter(F.col("bytes") >= least_shared)
    least = light.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first, so that the join has a shuffle on either side and a payload with very many pages can be split.
    least = materialize(least, "shared-payloads")
    later = light.join(least, "digest").filter("id > first or (id is null and first is not null)").select("page", "digest", "first").distinct()
    return pages.select("*", page, digest, size).repartition(parts, "page", "digest").join(later, ["page", "digest"], "left")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least_shared: int = LEAST_SHARED, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the three records of every row of ``pages`` into archives below ``path``."""
    pages = pages.select(F.col(id_col).cast("long").alias("id"), _header_value(F.col(url_col)).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    total = pages.agg(F.coalesce(F.sum(F.octet_length("payload") + 1000), F.lit(0))).first()[0]
    rows = first_holders(pages, least_shared, max(1, -(-total // archive_bytes))).withColumn("row", F.monotonically_increasing_id())
    page = F.col("page")
    name = lambda part: F.concat(F.lit("<urn:capture:"), page, F.lit(":"), F.col("row"), F.lit(f":{part}>"))
    concurrent, target = ("WARC-Concurrent-To", name("response")), ("WARC-Target-URI", F.col("url"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{STOP}"), F.when(revisit, "").otherwise(F.col("payload")))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", name("response")),
            target,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    request = _record("request", [("WARC-Record-ID", name("request")), concurrent, target, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{STOP}")))
    metadata = _record("metadata", [("WARC-Record-ID", name("metadata")), concurrent, target, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), page, F.lit(f"{END}payloadBytes: "), F.col("bytes"), F.lit(END)))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", STOP).option("compression", "gzip").text(path)


RECORD_SCHEMA = "capture string, kind string, record_id string, concurrent array<string>, target string, refers_to string, digest string, intact boolean, bytes long, page_id long, block binary"


def _members(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of one or more gzip members, or of one that is not packed, a step at a time."""
    at = 0
    if content[:2] != b"\x1f\x8b":
        yield from (content[k : k + step] for k in range(0, len(content), step))
        return
    while at < len(content):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            if at >= len(content) and not unzip.unconsumed_tail:
                raise ValueError("an archive ends within a gzip member")
            piece = unzip.unconsumed_tail or content[at : at + step]
            at += 0 if unzip.unconsumed_tail else len(piece)
            yield unzip.decompress(piece, step)
        at -= len(unzip.unused_data)


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[str, dict[str, list[str]], bytes]]:
    """``(type, headers, block)`` of each record; header names are lower-cased and have all of their values."""
    have = bytearray()

    def fill(n: int) -> bool:
        while len(have) < n:
            try:
                have.extend(next(chunks))
            except StopIteration:
                return False
        return True

    while True:
        while fill(2) and have[:2] == b"\r\n":
            del have[:2]
        if not fill(1):
            return
        seen = 0
        while (end := have.find(STOP.encode(), max(seen - 3, 0))) < 0:
            seen = len(have)
            if not fill(seen + 1):
                raise ValueError("a record's header does not end")
        lines = _text(bytes(have[:end])).split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields: dict[str, list[str]] = {}
        for k, _, v in (x.partition(":") for x in lines[1:]):
            fields.setdefault(k.strip().lower(), []).append(v.strip())
        stop = end + len(STOP) + int(fields["content-length"][0])
        if not fill(stop):
            raise ValueError("a record's block does not end")
        yield fields.get("warc-type", [""])[0], fields, bytes(have[end + len(STOP) : stop])
        del have[:stop]


def _declared(value: str | None) -> tuple[str, bytes] | None:
    """``(algorithm, digest)`` of a digest header in hexadecimal or base 32; None if it is neither or not known."""
    name, _, text = (value or "").partition(":")
    name = name.lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(name)
    for read in (bytes.fromhex, lambda t: base64.b32decode(t.upper() + "=" * (-len(t) % 8))):
        try:
            if size and len(raw := read(text)) == size:
                return name, raw
        except (ValueError, binascii.Error):
            continue
    return None


def _whole(notes: dict[str, str], name: str) -> int | None:
    try:
        return int(notes[name])
    except (KeyError, ValueError):
        return None


def _rows(content: bytes, payloads: bool, file: str = "") -> Iterator[dict]:
    for place, (kind, fields, block) in enumerate(parse_records(_members(content))):
        first = lambda name, fields=fields: fields.get(name, [None])[0]
        row = {"kind": kind, "record_id": first("warc-record-id") or f"<{file}:{place}>", "concurrent": fields.get("warc-concurrent-to", []), "target": first("warc-target-uri"), "refers_to": first("warc-refers-to")}
        row["capture"] = first("warc-concurrent-to") or row["record_id"]
        if kind in ("response", "revisit"):
            row["capture"] = row["record_id"]
            at = block.find(STOP.encode())
            payload = block[at + len(STOP) :] if at >= 0 else block  # without headers of its own
            declared = _declared(first("warc-payload-digest"))
            if kind == "response":
                whole = hashlib.sha256(payload).digest()
                intact = declared and (whole if declared[0] == "sha256" else hashlib.new(declared[0], payload).digest()) == declared[1]
                row |= {"digest": whole.hex(), "intact": intact, "bytes": len(payload)}
            else:
                row["digest"] = declared[1].hex() if declared and declared[0] == "sha256" else None
            row["block"] = payload if payloads else None
        elif kind == "metadata":
            notes = dict(x.split(": ", 1) for x in _text(block).split(END) if ": " in x)
            row |= {"bytes": _whole(notes, "payloadBytes"), "page_id": _whole(notes, "pageId")}
        elif payloads:
            row["block"] = block
        yield row


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for row in _rows(content.as_py(), payloads, name):
                    rows.append(row)
                    size += 500 + len(row.get("block") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _arrow_schema())
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow_schema())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])


def linked(records: DataFrame) -> DataFrame:
    """``records`` with one ``capture`` for all that name each other in WARC-Concurrent-To, directly or by others between."""
    links = materialize(records.select(F.col("record_id").alias("a"), F.explode("concurrent").alias("b")), "warc-links")
    found = materialize(components(links), "warc-captures")
    joined = records.join(found, records["record_id"] == found["node"], "left")
    return joined.select(*(F.coalesce(found["component"], records["record_id"]).alias(c) if c == "capture" else records[c] for c in records.columns))


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (or revisit), request and metadata, joined by concurrent-to identifiers."""
    answer = F.col("kind").isin("response", "revisit")
    part = lambda kind, *fields: F.first(F.when(kind, F.struct(*fields)), ignorenulls=True)
    return records.groupBy("capture").agg(
        part(answer, "kind", "record_id", "target", "refers_to", "digest", "intact", "bytes", F.col("block").alias("payload")).alias("response"),
        part(F.col("kind") == "request", "record_id", "target", "block").alias("request"),
        part(F.col("kind") == "metadata", "record_id", "page_id", "bytes").alias("metadata"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    whole = captures(read_records(spark, path, payloads=False)).filter("response is not null")
    damaged = F.raise_error(F.concat(F.col("response.record_id"), F.lit(": the payload does not have the declared digest")))
    whole = whole.withColumn("response", F.when(F.coalesce("response.intact", F.lit(True)), F.col("response")).otherwise(damaged))
    return whole.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.bytes", "metadata.bytes").alias("payload_bytes"),  # a revisit does not hold its payload
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long").alias("refers_to"),
    )
