"""WARC archives as chunked record tables.

Writing: each row of a table becomes the text of WARC records - a response, or a
revisit of the response with the same payload. A payload longer than ``SEGMENT`` bytes
goes out as the standard's segments: a first record and continuation records, each a
row of its own, so that no row holds a whole oversized record. Spark's own text sink
writes them with the record end as line end and gzip, commits them atomically and
reaches any store that Spark reaches; the files are ordinary ``.warc`` streams.

Reading: Spark's text source splits the streams at a separator; a parser takes the
pieces in file order and gives a chunk table: record id, chunk number, the chunk's
bytes, and the payload's length and SHA-1 so far, carried from chunk to chunk. The
last chunk's digest is that of the payload; it never needs the payload in one piece.
Archives of other writers are read, too: every record type, ids of any form (as text,
without brackets), blocks without HTTP head, absent or other payload digests (not
verified). They are read with ``separator="\n"``: a piece is then a line of a payload.

Defined results: a null payload is empty; of rows with equal payloads of at least
``min_revisit_bytes`` bytes the smallest id is the response (all rows with that id, if
it repeats; null ids only where no other is left), the others revisit it; an empty table
gives an empty archive and result; only id, URL and payload columns are read. Ids may be
of any atomic type. A digest that does not fit its header, a record that ends early and
a segment without its successor stop the read with an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize, new_path

SEGMENT = 1 << 20
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_revisits(df: DataFrame, *, id_col: str, payload_col: str, url_col: str = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """``df`` (id, URL, payload) with ``refers_to``: null for responses."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    keyed = df.withColumn("__sha", F.unhex(F.sha1(payload))).withColumn("__size", F.octet_length(payload))
    repeated = keyed.where(F.col("__size") >= min_revisit_bytes).groupBy("__sha").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__sha", "__first")
    # written first, so that both sides of the join are plain exchanges, which Spark splits where a payload has many rows
    joined = keyed.join(materialize(repeated, "warc-repeated"), "__sha", "left")
    own = F.col("__first").isNull() | F.col(id_col).eqNullSafe(F.col("__first"))
    return joined.select(id_col, url_col, payload_col, F.when(~own, F.col("__first")).alias("refers_to"))


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload, refers_to) rows to the text of records, without the record end."""
    for batch in batches:
        out: list[bytes] = []
        size = 0
        for i in range(batch.num_rows):
            rid, url, html, ref = (c[i].as_py() for c in batch.columns)
            for row in record_rows(rid, url, (html or "").encode(), ref):
                out.append(row)
                size += len(row)
                if size > 8 * SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def record_rows(rid, url: str | None, payload: bytes, ref) -> Iterator[bytes]:
    uri = "" if url is None else "".join(url.splitlines())
    head = HTTP % len(payload)
    kind = "response" if ref is None else "revisit"
    digest = hashlib.sha1()
    for at in range(0, len(payload), SEGMENT):
        digest.update(payload[at : at + SEGMENT])
    said = base32(digest.digest())
    body = payload[:SEGMENT] if ref is None else b""
    cut = ref is None and len(payload) > SEGMENT
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(rid)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{said}", "Content-Type: application/http;msgtype=response"]
    if ref is not None:
        lines += [f"WARC-Refers-To: {name(ref)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if cut:
        lines.append("WARC-Segment-Number: 1")
    yield ("\r\n".join([*lines, f"Content-Length: {len(head) + len(body)}"]) + END).encode() + head + body
    for number, at in enumerate(range(SEGMENT, len(payload), SEGMENT) if cut else (), 2):
        body = payload[at : at + SEGMENT]
        lines = ["WARC/1.1", "WARC-Type: continuation", f"WARC-Record-ID: {name(rid, number)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Segment-Number: {number}", f"WARC-Segment-Origin-ID: {name(rid)}"]
        if at + SEGMENT >= len(payload):
            lines.append(f"WARC-Segment-Total-Length: {len(head) + len(payload)}")
        yield ("\r\n".join([*lines, f"Content-Length: {len(body)}"]) + END).encode() + body


def name(rid, segment: int | None = None) -> str:
    place = "" if segment is None else f":segment:{segment}"
    return f"<urn:nil{place}>" if rid is None else f"<urn:page:{quote(str(rid), safe='')}{place}>"


def rid_of(value: str | None) -> str | None:
    """The id in a record's name: what ``name`` was given, or another writer's name."""
    text = (value or "").strip().removeprefix("<").removesuffix(">")
    if text.startswith("urn:page:"):
        return unquote(text.removeprefix("urn:page:"))
    return None if text in ("", "urn:nil") else text


def write_archive(planned: DataFrame, path: str) -> None:
    """Write (id, url, payload, refers_to) rows as gzipped WARC files under ``path``."""
    rows = in_batches(planned, records, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)


class Parser:
    """Pieces of a stream, cut at each ``separator``, to (header, block bytes) parts. A part
    is at most a piece, so that a block with separators in it comes in several."""

    def __init__(self, separator: str = END):
        self.separator = separator.encode()
        self.header: dict | None = None
        self.held = b""
        self.left = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict, bytes, bool]]:
        """(header, bytes of its block, whether the block ends) in one piece and its end."""
        data = piece + self.separator
        while data:
            if self.header is None:
                data = (self.held + data).lstrip(b"\r\n")  # what ended the record before
                if data[:5] != b"WARC/"[: len(data)] or len(data) > SEGMENT and END.encode() not in data[:SEGMENT]:
                    raise ValueError(f"no record begins with {data[:40]!r}")
                head, end, rest = data.partition(END.encode())
                self.held = b"" if end else data
                if not end:
                    return
                data = rest
                lines = head.decode("utf-8", "replace").split("\r\n")
                self.header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left = int(self.header["content-length"])
                if self.left and not data:
                    return
            part, data = data[: self.left], data[self.left :]
            self.left -= len(part)
            header = self.header
            if self.left == 0:
                self.header = None
            yield header, part, self.left == 0


CHUNKS = "record_id string, chunk long, data binary, record_type string, refers_to string, payload_bytes long, payload_digest string, last boolean"


def chunks(keep_data: bool, separator: str = END):
    """Parser of archive pieces into the chunk table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict | None = None
        parser = Parser(separator)
        for batch in batches:
            held = 0
            for i in range(batch.num_rows):
                piece = batch.column(0)[i].as_py()
                for header, data, ends in parser.feed(piece):
                    held += len(data)
                    state = advance(state, header, data, ends, out, keep_data)
                if held > 8 * SEGMENT:
                    yield _table(out)
                    out, held = [], 0
            yield _table(out)
            out = []
        if parser.header is not None or parser.held or state is not None and not state["over"]:
            raise ValueError("the archive ends inside a record")

    return run


def advance(state: dict | None, header: dict, data: bytes, ends: bool, out: list, keep_data: bool) -> dict:
    """Carry the record's chunk number, length and digest over one more part of a block."""
    kind = header["warc-type"]
    if state is None or state["over"]:
        if kind == "continuation":
            raise ValueError("a continuation without its first segment")
        http = header.get("content-type", "").startswith("application/http")
        state = {"h": header, "now": header, "n": 0, "size": 0, "sha": hashlib.sha1(), "http": b"", "head": not http, "over": False, "length": None}
    elif header is not state["now"]:
        if kind != "continuation":
            raise ValueError(f"a segment of {state['h']['warc-record-id']} is missing")
        state["now"] = header
    if not state["head"]:
        state["http"] += data
        at = state["http"].find(END.encode())
        if at < 0 and not ends:
            return state
        head, data = (state["http"][:at], state["http"][at + 4 :]) if at >= 0 else (state["http"], b"")
        for line in head.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                state["length"] = int(line.split(b":")[1])
        state["head"], state["http"] = True, b""
    state["sha"].update(data)
    state["size"] += len(data)
    h = state["h"]
    more = "warc-segment-number" in h and "warc-segment-total-length" not in header
    last = ends and not more
    said = h.get("warc-payload-digest", "")
    said = said.removeprefix("sha1:") if said.startswith("sha1:") else None
    digest, size = base32(state["sha"].digest()), state["size"]
    if last and h["warc-type"] == "revisit":  # the payload is its response's
        digest, size = said, state["length"]
    elif last and said is not None and digest != said:
        raise ValueError(f"the payload of {h['warc-record-id']} does not fit its digest")
    out.append((rid_of(h["warc-record-id"]), state["n"], data if keep_data else None, h["warc-type"], rid_of(h.get("warc-refers-to")), size, digest, last))
    state["n"] += 1
    state["over"] = last
    return state


def _table(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])


def read_archive(spark: SparkSession, path: str, *, keep_data: bool = True, separator: str = END, id_type: str = "long") -> DataFrame:
    """The chunk table of the gzipped archives under ``path``, ids as ``id_type``. Such files
    are not split, so that each is parsed as one stream (plain files must be gzipped first);
    memory is one piece of one record. Archives written here have pieces of at most a segment
    at the record end; those of other writers take ``separator="\n", id_type="string"``."""
    pieces = spark.read.option("lineSep", separator).text(path).select(F.col("value").cast("binary").alias("value"))
    found = in_batches(pieces, chunks(keep_data, separator), CHUNKS)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("record_id", "refers_to")})


def op1_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_archive(plan_revisits(pages, id_col="page_id", payload_col="html"), path)
    found = read_archive(spark, path, keep_data=False, id_type=pages.schema["page_id"].dataType.simpleString()).where("last")
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
