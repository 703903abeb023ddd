"""WARC archives of captures, and assembly of their transactions when read back.

Writing: a capture is a response or revisit record, a request record and a metadata record; the
two latter point to the first by WARC-Concurrent-To. Each record is a gzip member of its own.
Captures with equal payloads of at least `least` bytes share one response, that with the largest
page_id; the others are revisits that name its record id, which follows from page_id and digest.
Only digests and ids meet in that shuffle; they are summed up per digest before, so a payload
that a third of the pages share is no hot key.

Reading: records of all files are joined by the concurrent-to identifier, whatever file they are
in, into one nested row a capture. Payloads stay out of the shuffle unless they are asked for.
The page a revisit refers to is looked up by the record id it names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import new_folder, open_file, ship, stored, write_file

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 20_000
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, uri string, "
          "digest string, page_id long, payload_bytes long, payload_sha1 string, fields string, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _few(side: DataFrame) -> DataFrame:
    """Few rows, once counted, go to all tasks; else it is a join whose hot partitions Spark splits."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds `_leader`, the page_id of the response with this payload (null if it stands alone),
    and `_named`: whether this row is the one response that revisits name.

    Rows that repeat the largest page_id of a payload are stored, so that the choice of one of
    them holds whenever a lost task reads its input again.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("_sha"), F.octet_length(html).alias("_n"))
    each = rows.where(F.col("_n") >= least).groupBy("_sha", "page_id").agg(F.count("*").alias("_rows"))
    groups = each.groupBy("_sha").agg(
        F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "_rows"))).alias("_top"),
        F.sum("_rows").alias("_all")).where("_all > 1").select(
        "_sha", F.col("_top.page_id").alias("_leader"), F.coalesce(F.col("_top._rows") == 1, F.lit(True)).alias("_lone"))
    groups = stored(groups, "payloads")
    joined = rows.join(_few(groups), "_sha", "left")
    joined = joined.withColumn("_leader", F.when(F.col("_n") >= least, F.col("_leader")))
    head = F.coalesce(F.col("page_id") == F.col("_leader"), F.lit(False))
    if not groups.where("NOT _lone").limit(1).count():
        return joined.withColumn("_named", head)
    repeated = stored(joined.where(head & ~F.col("_lone")).withColumn("_line", F.monotonically_increasing_id()), "repeated")
    firsts = repeated.groupBy("_sha").agg(F.min("_line").alias("_first"))
    repeated = repeated.join(_few(firsts), "_sha").withColumn("_named", F.col("_line") == F.col("_first"))
    others = joined.where(~head | F.col("_lone")).withColumn("_named", head)
    return others.unionByName(repeated.drop("_line", "_first"))


def _line(text) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c.isascii() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=4, mtime=0) as f:
        f.write(VERSION + b"\r\n" + head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out.getvalue()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def response_id(page_id: int, digest: str) -> str:
    """Id of the response that revisits with this payload name."""
    return record_id(f"page/{page_id}/{digest}")


def capture(
    page_id: int | None, url: str | None, html: str | None, leader: int | None, name: str, named: bool = False,
) -> list[bytes]:
    """The three records of one capture; `name` makes their identifiers unique, but a response
    that is `named` has the identifier that revisits know."""
    payload = (html or "").encode()
    digest = base32_sha1(payload)
    ids = {k: record_id(f"{name}/{k}") for k in ("main", "request", "metadata")}
    if named:
        ids["main"] = response_id(page_id, digest)
    revisit = leader is not None and leader != page_id
    uri = _line(url) if url else "urn:page"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()

    def headers(kind, record, mime):
        return [("WARC-Type", kind), ("WARC-Record-ID", ids[record]), ("WARC-Date", DATE),
                ("WARC-Target-URI", uri), ("Content-Type", mime)]

    main = headers("revisit" if revisit else "response", "main", "application/http; msgtype=response")
    main.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(leader, digest))]
    other = [("WARC-Concurrent-To", ids["main"])]
    ask = f"GET {uri} HTTP/1.1\r\nUser-Agent: loanweave\r\n\r\n".encode()
    about = json.dumps({"page_id": page_id, "url": url, "payload_bytes": len(payload)}).encode()
    return [_member(main, head if revisit else head + payload),
            _member(headers("request", "request", "application/http; msgtype=request") + other, ask),
            _member(headers("metadata", "metadata", "application/json") + other, about)]


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write archives; a row with path, bytes and captures for each committed file."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {"captures": 0}
        name = uuid.uuid4().hex

        def chunks():
            yield _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                           ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC 1.1\r\n")
            for batch in batches:
                for row in batch.to_pylist():
                    yield from capture(row["page_id"], row["url"], row["html"], row["_leader"],
                                       f"{name}/{done['captures']}", row["_named"])
                    done["captures"] += 1

        path, size = write_file(folder, "pages.warc.gz", chunks())
        if done["captures"]:
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "captures": done["captures"]}])

    typed = with_types(pages, least).select(F.col("page_id").cast("long"), "url", "html", F.col("_leader").cast("long"), "_named")
    return stored(typed.mapInArrow(run, "path string, bytes long, captures long"), "archives")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip-per-record archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not the start of a WARC record")
            headers: dict[str, str] = {}
            while (line := f.readline()) and line != b"\r\n":
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            yield headers, f.read(int(headers["content-length"]))


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """One row a record of the listed files."""
    ship(archives.sparkSession)

    def row(h: dict[str, str], block: bytes) -> dict:
        kind = h["warc-type"]
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        about = json.loads(block) if kind == "metadata" and h.get("content-type") == "application/json" else {}
        return {
            "record_id": h["warc-record-id"], "type": kind, "concurrent_to": h.get("warc-concurrent-to"),
            "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"),
            "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "page_id": about.get("page_id"),
            "payload_bytes": about.get("payload_bytes") if payload is None else len(payload),
            "payload_sha1": None if payload is None else base32_sha1(payload),
            "fields": None if kind in ("response", "revisit") else block.decode("utf-8", "replace"),
            "payload": payload}

    def run(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                            for n, t in (c.split() for c in RECORD.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with open_file(folder, path) as stream:
                    for h, block in records(stream):
                        held.append(row(h, block))
                        size += len(block)
                        if size > 4 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path").mapInArrow(run, RECORD)


def transactions(found: DataFrame, payloads: bool = False) -> DataFrame:
    """One nested row a capture: the response or revisit, its requests and its metadata.

    Records are put together by the identifier they are concurrent to. A capture whose main
    record is missing keeps its other records and has a null `main`; a main record without
    others has empty lists. Records that are neither (warcinfo) are left out. A capture has few
    records, as the archives' writers decide, so its lists are small.
    """
    main = F.col("type").isin("response", "revisit")
    kept = ["record_id", "type", "refers_to", "uri", "digest", "payload_bytes", "payload_sha1"]
    kept += ["payload"] if payloads else []
    rows = found.where(main | F.col("type").isin("request", "metadata"))
    rows = rows.withColumn("capture", F.when(main, F.col("record_id")).otherwise(
        F.coalesce("concurrent_to", "record_id")))
    return rows.groupBy("capture").agg(
        F.first(F.when(main, F.struct(*kept)), ignorenulls=True).alias("main"),
        F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "uri", "fields"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "page_id", "payload_bytes", "fields"))).alias("metadata"))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """`captures` without the nested columns: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    return captures(pages, least).drop("main", "requests", "metadata")


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read the captures back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, and the capture itself:
    main, requests, metadata. `refers_to` is the page of the record that a revisit names, found
    in the archives by that record's id. Null html is an empty payload, and empty payloads are
    equal to each other. Rows that repeat the largest page_id of a payload are all responses;
    revisits name one of them. A null page_id is a response if it stands alone, and never one
    that others refer to. An empty table writes nothing and gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    archives = write(pages, folder, least)
    found = transactions(read_records(archives.repartition(max(1, archives.count())), folder))
    found = stored(found, "captures")
    page = F.col("metadata")[0]["page_id"]
    # One row for each payload that several pages share.
    wanted = found.select(F.col("main.refers_to").alias("capture")).where("capture IS NOT NULL").distinct()
    named = stored(found.select("capture", page.alias("refers_to")).join(wanted, "capture", "left_semi"), "named")
    named = _few(named).withColumnRenamed("capture", "_named")
    found = found.join(named, F.col("main.refers_to") == F.col("_named"), "left")
    about = F.col("metadata")[0]
    return found.select(
        about["page_id"].alias("page_id"),
        F.coalesce(about["payload_bytes"], F.col("main.payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.col("main.payload_sha1"), F.col("main.digest")).alias("payload_digest"),
        F.col("main.type").alias("record_type"), "refers_to", "main", "requests", "metadata")
