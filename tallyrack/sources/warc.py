"""Stored page dumps (WARC, ISO 28500) as a table or a stream, and fetches answered from them.

A Python data source: one partition a file (a compressed file can't be cut), which is read as a stream of records.
Filters on status and host reach the reader, so records that fail them are skipped before their bodies are decoded.  A
stream's offset is the name of the last file, so files are to be named in the order they come.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any, BinaryIO
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions import urls as U
from ..functions.dialect import SPARK
from ..plans.lineage import settle
from .writer import filesystem

RECORD = "url string, host string, fetched timestamp, status int, location string, content_type string, html string, file string"
#: Hops that a fetch goes, at most.
HOPS = 20


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("latin-1").splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of every record; a file that ends within one ends there."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = bytearray()
        while (line := stream.readline()).strip():
            head += line
        if not line:
            return
        headers = _headers(bytes(head))
        size = int(headers.get("content-length", "0"))
        content = stream.read(size)
        if len(content) < size:
            return
        yield headers, content


def response(headers: dict[str, str], content: bytes, wanted: dict[str, set]) -> tuple | None:
    """The row of a response record, null for other records and those that a filter leaves out."""
    if headers.get("warc-type") != "response":
        return None
    url = headers.get("warc-target-uri", "").strip("<>")
    host = (urlsplit(url).hostname or "").removeprefix("www.")
    status = re.match(rb"HTTP/\S+ (\d{3})", content)
    code = int(status[1]) if status else None
    if ("host" in wanted and host not in wanted["host"]) or ("status" in wanted and code not in wanted["status"]):
        return None
    head, _, body = content.partition(b"\r\n\r\n")
    http = _headers(head)
    if http.get("content-encoding", "").lower() == "gzip":
        body = gzip.decompress(body)
    charset = re.search(r"charset=\"?([\w-]+)", http.get("content-type", ""))
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    at = headers.get("warc-date", "")[:19]
    fetched = datetime.strptime(at, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC) if at else None
    return url, host, fetched, code, http.get("location"), http.get("content-type"), html


def _files(path: str) -> list[str]:
    store, root = filesystem(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))


@dataclass
class DumpFile(InputPartition):
    file: str


def _read(path: str, file: str, wanted: dict[str, set]) -> Iterator[tuple]:
    store, _ = filesystem(path)
    with store.open_input_stream(file, compression=None) as raw:
        plain: Any = gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw
        for headers, content in records(io.BufferedReader(plain) if not file.endswith(".gz") else plain):
            row = response(headers, content, wanted)
            if row:
                yield (*row, file)


class DumpReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("status",), ("host",)):
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[DumpFile]:
        return [DumpFile(f) for f in _files(self.path)]

    def read(self, partition: DumpFile | None) -> Iterator[tuple]:
        if partition is not None:  # no file, no partition
            yield from _read(self.path, partition.file, self.wanted)


class DumpStream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_files(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[DumpFile]:
        return [DumpFile(f) for f in _files(self.path) if start["after"] < f <= end["after"]]

    def read(self, partition: DumpFile) -> Iterator[tuple]:
        yield from _read(self.path, partition.file, {})


class DumpSource(DataSource):
    """spark.read or readStream, .format("page_dump").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "page_dump"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DumpReader:
        return DumpReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DumpStream:
        return DumpStream(self.options["path"])


def dump(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DumpSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("page_dump").load(path)


def dump_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DumpSource)
    return spark.readStream.format("page_dump").load(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, location, html) of a store, by what it holds: WARC dumps, Parquet, or JSON lines."""
    if re.search(r"\.parquet/?$", path):
        held = spark.read.parquet(path)
    elif re.search(r"\.jsonl?(\.gz)?/?$", path):
        held = spark.read.schema("url string, status int, location string, html string").json(path)
    else:
        held = dump(spark, path)
    known = set(held.columns)
    return held.select("url", (F.col("status") if "status" in known else F.lit(200)).cast("int").alias("status"), (F.col("location") if "location" in known else F.lit(None)).cast("string").alias("location"), "html")


def fetched(wanted: DataFrame, pages: DataFrame, hops: int = HOPS) -> DataFrame:
    """Wanted (url), pages (url, status, location, html) -> (url, final_url, status, html, error): redirects are
    followed one join a hop, until none is left; a status of 400 or more, too many hops and a page that isn't stored are
    errors.  Of an address stored several times the first by status and text counts."""
    first = F.min(F.struct("status", "location", "html"))
    once = settle(pages.filter("url IS NOT NULL").groupBy("url").agg(first.alias("p")).select("url", "p.*"))
    onward = once.filter("status BETWEEN 300 AND 399 AND location IS NOT NULL").select(F.col("url").alias("at"), F.expr(U.join(SPARK, "url", "location")).alias("to"))
    live = settle(wanted.select("url").distinct().withColumn("at", F.col("url")))
    done: list[DataFrame] = []
    for _ in range(hops):
        step = settle(live.join(onward, "at", "left"))
        done.append(step.filter("to IS NULL").select("url", F.col("at").alias("final_url"), F.lit(None).cast("string").alias("error")))
        live = step.filter("to IS NOT NULL").select("url", F.col("to").alias("at"))
        if live.isEmpty():
            break
    done.append(live.select("url", F.col("at").alias("final_url"), F.lit("too_many_redirects").alias("error")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    held = out.join(once.select(F.col("url").alias("final_url"), "status", "html"), "final_url", "left")
    error = F.coalesce("error", F.when(F.col("status").isNull(), "page_load_failed").when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status"))))
    return held.select("url", "final_url", "status", F.when(error.isNull(), F.col("html")).alias("html"), error.alias("error"))
