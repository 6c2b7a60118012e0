"""WARC archives: records are written in segments with chunked transfer framing, and reassembled from the files.

Writing: each page is a ``response`` record (or a ``revisit`` of the page with the same payload). Its block is an
HTTP head and the payload in chunked framing; blocks above ``segment_bytes`` are cut into a first record and
``continuation`` records that name the first one, their number and, in the last, the total length. Files are made
by Spark's text writer, whose line separator is the blank line that ends a record, so they land in any store that
Spark reaches, and no record is larger than a segment.

Reading: the archives are parsed record by record by Content-Length. Records that are not segmented are complete
where they stand; only segments are grouped by their origin, ordered by number, checked against the total length
and joined, before the chunked framing is decoded and the payload's digest verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, sized, stored

CRLF = b"\r\n"
SEGMENT, CHUNK, PER_FILE = 16 << 10, 8 << 10, 2000
READ = "record_id string, record_type string, uri string, refers_to string, declared string, payload binary, payload_bytes long, problem string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: each five hex digits are four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return F.translate(F.upper(F.concat(*parts)), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes) -> bytes:
    out = []
    for i in range(0, len(payload), CHUNK):
        piece = payload[i : i + CHUNK]
        out += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing (chunk extensions and trailers are skipped); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk length")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, rid: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    """A record without the blank line that ends it, which the writer adds."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + rid.encode() + b">", b"WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"{k}: {v}".encode() for k, v in extra]
    return CRLF.join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block


def _records(segment_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, held = [], 0
            for key, url, payload, n, digest, refers in pdf[["key", "url", "payload", "n", "digest", "refers"]].itertuples(index=False):
                rid = f"urn:page:{key}:{digest}"
                url = " ".join((url or "").split())  # a header is one line
                extra = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers:
                    extra += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>")]
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                if len(block) <= segment_bytes:
                    out.append(_record("revisit" if refers else "response", rid, block, extra))
                else:
                    cuts = range(0, len(block), segment_bytes)
                    for i, c in enumerate(cuts, 1):
                        seg = [("WARC-Segment-Number", str(i))]
                        if i > 1:
                            seg.append(("WARC-Segment-Origin-ID", f"<{rid}>"))
                        if i == len(cuts):
                            seg.append(("WARC-Segment-Total-Length", str(len(block))))
                        out.append(_record("response" if i == 1 else "continuation", rid if i == 1 else f"{rid}:{i}", block[c : c + segment_bytes], [*(extra if i == 1 else []), *seg]))
                held += len(block)
                if held > 8 << 20:
                    yield pd.DataFrame({"value": out})
                    out, held = [], 0
            yield pd.DataFrame({"value": out})

    return run


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) as gzip-compressed WARC files under ``path``.

    Null html is an empty payload, a null url an empty one. Of pages with equal payloads of at least
    ``min_revisit_bytes`` bytes, that with the smallest page_id is the response and the others revisit it; smaller
    ones are all responses. Rows without a page_id are responses with an identifier of their own. Repeated rows
    of a page_id are all written and all read again; a record's identifier holds page_id and digest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"n": F.octet_length("payload").cast("long"), "digest": payload_digest(F.col("payload"))})
    lead = p.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("lead"), F.max("page_id").alias("last"))
    lead = stored(lead.where("lead < last").select("digest", "lead"), "leaders")
    p = p.join(sized(lead), "digest", "left")
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none-"), F.expr("uuid()")))
    refers = F.when((F.col("page_id") > F.col("lead")) & (F.col("n") >= min_revisit_bytes), F.col("lead").cast("string"))
    rows = p.select(key.alias("key"), "url", "payload", "n", "digest", refers.alias("refers"))
    out = rows.mapInPandas(_records(segment_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def _plain(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":  # members may follow one another
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out) if out else data


def _heads(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _parsed(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(CRLF * 2, at)
        h = _heads(data[at:end].split(CRLF)[1:])
        n = int(h["content-length"])
        yield h, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def _finish(h: dict[str, str], block: bytes) -> tuple:
    """A row of READ from a whole record."""
    head, _, body = block.partition(CRLF * 2)
    http = _heads(head.split(CRLF)[1:])
    problem, declared = None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = h.get("warc-type") == "revisit"
    payload, n = body, int(http.get("content-length", 0)) if revisit else len(body)
    try:
        if http.get("transfer-encoding", "").lower() == "chunked" and not revisit:
            payload = unchunked(body)
            n = len(payload)
    except ValueError:
        problem = "chunked framing"
    if not revisit and problem is None and declared and base64.b32encode(hashlib.sha1(payload).digest()).decode() != declared:
        problem = "digest"
    return (h["warc-record-id"].strip("<>"), h.get("warc-type"), h.get("warc-target-uri"), (h.get("warc-refers-to") or "").strip("<>") or None, declared, None if revisit else payload, n, problem)


_COLUMNS = [c.split()[0] for c in READ.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The logical records of the WARC files under ``path``, whole again, one row each (columns of READ).

    ``problem`` says what is wrong with a record: a missing segment, a wrong total length, broken chunked framing or
    a digest that does not match; such records are returned, not dropped. Files of any number of gzip members, or
    plain ones, are read; other record types than response, revisit and continuation are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def parse(frames):
        for f in frames:
            for data in f["content"]:
                rows, held = [], 0
                for h, block in _parsed(_plain(data)):
                    if h.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    held += len(block)
                    if "warc-segment-number" in h:
                        origin = (h.get("warc-segment-origin-id") or h["warc-record-id"]).strip("<>")
                        rows.append((*[None] * 8, origin, int(h["warc-segment-number"]), int(h.get("warc-segment-total-length", -1)), "\n".join(f"{k}:{v}" for k, v in h.items()), block))
                    else:
                        rows.append((*_finish(h, block), None, None, None, None, None))
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=[*_COLUMNS, "origin", "number", "total", "head", "block"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=[*_COLUMNS, "origin", "number", "total", "head", "block"])

    parsed = stored(files.mapInPandas(parse, READ + ", origin string, number long, total long, head string, block binary"), "records")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("number").drop_duplicates("number")
        block = b"".join(s["block"])
        h = _heads([x.encode() for x in s["head"].iloc[0].split("\n")])
        problem = None
        if s["number"].tolist() != list(range(1, len(s) + 1)) or s["total"].max() < 0:
            problem = "missing segment"
        elif len(block) != s["total"].max():
            problem = "total length"
        row = list(_finish(h, block)) if s["number"].iloc[0] == 1 else [pdf["origin"].iloc[0], "continuation", *[None] * 5, None]
        row[-1] = problem or row[-1]
        return pd.DataFrame([row] * max(1, int((pdf["number"] == 1).sum())), columns=_COLUMNS)

    whole = parsed.where("origin is null").select(*_COLUMNS)
    cut = parsed.where("origin is not null").select("origin", "number", "total", "head", "block")
    return whole.unionByName(cut.groupBy("origin").applyInPandas(join, READ))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and digests what came out.

    Per written page: page_id, payload_bytes, payload_digest, record_type, refers_to. Digests are taken again from
    the payloads read; a revisit's are the ones that its record declares. Raises if a record came back with a problem.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_revisit_bytes)
    r = read_archives(spark, path)
    digest = F.when(F.col("payload").isNull(), F.col("declared")).otherwise(payload_digest(F.col("payload")))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+):', 1) as long)")
    return r.select(
        page("record_id").alias("page_id"),
        F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("record "), "record_id", F.lit(": "), "problem")).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
