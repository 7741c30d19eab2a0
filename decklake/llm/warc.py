"""WARC: not-modified revisits resolved to what they refer to (operator 9).

A revisit record has no body: the server said that nothing had changed.  It is
resolved by an as-of join to the latest earlier full response of the same
canonical URL, if the validators of both agree; the headers that a 304 answer
may carry then replace the response's.

A URL that is captured very often is no single group: all captures are cut at
quantiles of URL, time and record into stretches, in each of which a window
finds the latest response; what a stretch starts with is carried over from the
ones before.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import make_room, written

# Header fields that a 304 answer carries (RFC 9110, 15.4.5), and query fields that name a campaign, not a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"

def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking fields and a slash at the end; the host in lower case; query fields sorted.

    Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\d?\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda f: (f != "") & ~f.rlike(rf"^{TRACKING}(=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with the revisit's permitted ones in their place; names in lower case, of those that differ in case only the last by code point."""

    def low(m: Column) -> Column:
        entries, size = F.array_sort(F.map_entries(F.transform_values(m, lambda _, v: F.struct(v.alias("text"))))), F.size(m)
        names = F.transform(entries, lambda e: F.lower(e.key))
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        last = F.filter(places, lambda i: ~F.array_contains(F.slice(names, i + 2, size), F.get(names, i)))
        return F.map_from_arrays(F.transform(last, lambda i: F.get(names, i)), F.transform(last, lambda i: F.get(entries, i)["value"]["text"]))

    allowed = F.map_filter(low(revisit), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(low(response), lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


HELD = ("captured", "record_id", "etag", "last_modified", "digest", "headers")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the response that each revisit refers to.

    Columns needed: record_id (distinct), url, captured (timestamp or number),
    kind ('response', 'revisit'; others, null too, pass through), etag,
    last_modified, digest, headers (map<string, string>).  New columns:
    ``canonical``, ``refers_to`` (the latest earlier full response of the
    canonical URL; captures at the same time go by record id), ``status``
    ('resolved', 'mismatch' if a validator that both have differs or they
    share none, 'missing' if there is no earlier response, null for what is no
    revisit) and ``merged`` (headers of resolved revisits).  Records without a
    URL or time are 'missing' if revisits, and are never referred to; their
    ``canonical`` is null.  Repeated rows stay.  An empty table gives an empty
    result.  Columns with a new one's name go on as ``<name>_in``.
    """
    records = make_room(records, "canonical", "refers_to", "status", "merged", "stretch", "latest", "carried", "found")
    revisit = F.col("kind").eqNullSafe("revisit")
    rows = records.withColumn("canonical", canonical_url(F.col("url")))
    usable = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    # Ranges are neighbours in this order, so that a stretch is all that lies between two cuts; they are drawn by sampling, so the rows are written once.
    ranged = rows.filter(usable).repartitionByRange("canonical", "captured", "record_id").withColumn("stretch", F.spark_partition_id())
    cut, _ = written(ranged, "stretches")
    full = F.col("kind") == "response"
    within = Window.partitionBy("canonical", "stretch").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.filter(full).groupBy("canonical", "stretch").agg(F.max_by(F.struct(*HELD), F.struct("captured", "record_id")).alias("end"))
    # A URL has as many of these rows as stretches, and only what lies in several needs them.
    several = cut.groupBy("canonical").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).filter("low < high")
    spans = several.select("canonical", F.explode(F.sequence("low", "high")).alias("stretch")).join(ends, ["canonical", "stretch"], "left")
    before = Window.partitionBy("canonical").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical", "stretch", F.last("end", ignorenulls=True).over(before).alias("carried")).filter("carried is not null")
    cut = cut.withColumn("latest", F.last(F.when(full, F.struct(*HELD)), ignorenulls=True).over(within)).join(carried, ["canonical", "stretch"], "left")
    cut = cut.withColumn("found", F.when(revisit, F.coalesce("latest", "carried")))
    same = lambda c: F.col(c) == F.col(f"found.{c}")  # noqa: E731  null if either lacks it
    agree = F.coalesce(same("etag") | same("last_modified") | same("digest"), F.lit(False))
    differ = F.coalesce(~same("etag"), F.lit(False)) | F.coalesce(~same("last_modified"), F.lit(False)) | F.coalesce(~same("digest"), F.lit(False))
    cut = cut.withColumns({"status": F.when(~revisit, F.lit(None).cast("string")).when(F.col("found").isNull(), "missing").when(agree & ~differ, "resolved").otherwise("mismatch"), "refers_to": F.col("found.record_id")})
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    cut = cut.withColumn("merged", F.when(F.col("status") == "resolved", merged_headers(F.coalesce("found.headers", none), F.coalesce("headers", none))))
    rest = rows.filter(~usable).withColumns({"canonical": F.lit(None).cast("string"), "refers_to": F.lit(None).cast(records.schema["record_id"].dataType), "status": F.when(revisit, "missing"), "merged": F.lit(None).cast("map<string,string>")})
    out = [*records.columns, "canonical", "refers_to", "status", "merged"]
    return cut.select(*out).unionByName(rest.select(*out))


RECORD = "record_id string, url string, captured timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>, body binary, file string, problem string"


#: Compressed bytes that are looked at together, and bytes of the largest body that is kept.
STEP, MOST_BODY = 1 << 14, 64 << 20


class _Stream(io.RawIOBase):
    """The bytes of a WARC file, member after member if it is compressed; no more is inflated than is asked for."""

    def __init__(self, content: bytes):
        self.content, self.at, self.member, self.rest = memoryview(content), 0, None, b""
        self.gz = bytes(self.content[:2]) == b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def _next(self, most: int) -> bytes:
        part = bytes(self.content[self.at : self.at + most])
        self.at += len(part)
        return part

    def _inflated(self, most: int) -> bytes:
        """Up to ``most`` bytes; none at the end."""
        while True:
            self.rest = self.rest or self._next(STEP)
            if not self.rest:
                return b""
            self.member = self.member or zlib.decompressobj(31)
            out = self.member.decompress(self.rest, most)
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            else:
                self.rest = self.member.unconsumed_tail
            if out:
                return out

    def readinto(self, into) -> int:
        part = self._inflated(len(into)) if self.gz else self._next(len(into))
        into[: len(part)] = part
        return len(part)


def _block(source: io.BufferedReader, size: int, most: int) -> tuple[bytes, int]:
    """A record's block up to ``most`` bytes, and how many it has; what is beyond is passed over a step at a time."""
    block = source.read(min(size, most))
    got = len(block)
    while got < size and (part := source.read(min(size - got, 1 << 20))):
        got += len(part)
    if got < size:
        raise ValueError("a record is cut off")
    return block, size


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {name.strip(): value.strip() for name, _, value in pairs}


def records_of(content: bytes, file: str = "", most_body: int = MOST_BODY) -> Iterator[dict]:
    """Records of one file; what can't be read ends it with a row that says why, and so does a file that is cut off.

    A record of over ``most_body`` bytes keeps its fields; its body is null and ``problem`` says so.
    """
    source = io.BufferedReader(_Stream(content))
    blank = {"record_id": None, "url": None, "captured": None, "kind": None, "etag": None, "last_modified": None, "digest": None, "headers": {}, "body": None, "file": file, "problem": None}
    try:
        while line := source.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record where one should begin")
            head = _fields(iter(lambda: source.readline().rstrip(b"\r\n"), b""))
            own = {k.lower(): v for k, v in head.items()}
            size = int(own["content-length"])
            if size < 0:
                raise ValueError("a length below 0")
            block, _ = _block(source, size, most_body)
            http, _, body = block.partition(b"\r\n\r\n") if own.get("content-type", "").startswith("application/http") else (b"", b"", block)
            headers = _fields(http.split(b"\r\n")[1:])
            low = {k.lower(): v for k, v in headers.items()}
            captured = pd.to_datetime(own.get("warc-date"), errors="coerce", utc=True)
            yield blank | {
                "record_id": own.get("warc-record-id", "").strip("<>") or None, "url": own.get("warc-target-uri", "").strip("<>") or None, "captured": None if captured is pd.NaT or captured is None else captured.tz_convert(None),
                "kind": own.get("warc-type"), "etag": low.get("etag"), "last_modified": low.get("last-modified"), "digest": own.get("warc-payload-digest"), "headers": headers, "body": body if size <= most_body else None,
                "problem": None if size <= most_body else f"a body of {size} bytes is left out",
            }
    except (ValueError, KeyError, zlib.error) as error:
        yield blank | {"kind": "unreadable", "problem": f"{type(error).__name__}: {error}"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (.warc, .warc.gz), ready for ``resolve_revisits``: one file is a task's, and under 2 GB.

    Rows of kind ``unreadable`` have the ``problem`` that ended a file.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for record in records_of(content, name):
                    rows.append(record)
                    held += len(record["body"] or b"")
                    if held > 8 << 20:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records that a crawler would have of ``pages``: one full response each, and one later conditional request for the same URL.

    The first visit is at second 10 x page_id; the second one 5 seconds to a
    few thousand later, by a hash of the URL.  The server's ETag is the body's
    MD5; of one in eight pages it changed in between without a new body being
    stored, so that the revisit doesn't match.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "url", "page_id")), 1, 8), 16, 10).cast("long")
    etag = F.md5(F.coalesce("html", F.lit("")))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    base = pages.select("page_id", "url", etag.alias("tag"), h.alias("h"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    visit = lambda kind, number, at, tag, headers: F.struct((F.col("page_id") * 2 + number).alias("record_id"), F.lit(kind).alias("kind"), at.alias("captured"), tag.alias("etag"), headers.alias("headers"))
    first, later = F.col("page_id") * 10, F.col("page_id") * 10 + 5 + F.pmod("h", F.lit(4000))
    changed = F.when(F.pmod(F.col("h"), F.lit(8)) == 0, F.md5(F.concat("tag", F.lit("*")))).otherwise(F.col("tag"))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("bytes")), F.lit("ETag"), F.col("tag"), F.lit("Date"), text(first))
    short = F.create_map(F.lit("ETag"), changed, F.lit("Date"), text(later), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"))
    both = F.array(visit("response", 0, first, F.col("tag"), full), visit("revisit", 1, later, changed, short))
    rows = base.select("url", F.explode(both).alias("r")).select("url", "r.*")
    return rows.withColumns({"last_modified": F.lit(None).cast("string"), "digest": F.lit(None).cast("string")})
