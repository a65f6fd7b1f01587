"""Exports as the files that readers expect (K2, K3): <root>/<job>/<export>.<fmt>, whole or not at all.

A Python data source.  Tasks write into a staging folder of the run; only when all have succeeded does the driver move
the files to their places, so a lost executor or a repeated task leaves nothing behind, and a run that is repeated puts
the same files in place again.  A job's rows come to one task in order (a job is bounded by its request).
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "job_id string, export_id string, columns array<string>, row_index long, data string"
FORMATS = ("csv", "json")


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """A path's file system: any that has an address, or the one that all machines mount."""
    return fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]+://|file:", root) else (fs.LocalFileSystem(), root)


def cell(value):
    """A value of a row; nested ones as JSON text."""
    return value if value is None or isinstance(value, (str, int, float, bool)) else json.dumps(value, ensure_ascii=False)


class _File:
    """One export while its rows come in."""

    def __init__(self, kind: str, columns: list[str]) -> None:
        self.kind, self.columns, self.n = kind, columns, 0
        self.text = io.StringIO(newline="")
        if kind == "csv":
            self.table = csv.DictWriter(self.text, columns, extrasaction="ignore")
            self.table.writeheader()

    def add(self, row: dict) -> None:
        own = {c: cell(row.get(c)) for c in self.columns}
        if self.kind == "csv":
            self.table.writerow({c: "" if v is None else v for c, v in own.items()})
        else:
            self.text.write(("," if self.n else "[") + json.dumps(own, ensure_ascii=False, separators=(",", ":")))
        self.n += 1

    def content(self) -> bytes:
        end = "" if self.kind == "csv" else "]" if self.n else "[]"
        return (self.text.getvalue() + end).encode()


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: where they are and where they go."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, root: str, kind: str) -> None:
        if kind not in FORMATS:
            raise ValueError(f"unsupported export format: {kind}")
        self.root, self.kind, self.run = root.rstrip("/"), kind, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = filesystem(self.root)
        staging = f"{root}/.staging-{self.run}/{uuid.uuid4().hex}"
        done, key, own = Staged(), None, None

        def close() -> None:
            name = f"{len(done.moves)}.{self.kind}"
            store.create_dir(staging, recursive=True)
            with store.open_output_stream(f"{staging}/{name}") as out:
                out.write(own.content())
            done.moves.append((f"{staging}/{name}", f"{root}/{key[0]}/{key[1]}.{self.kind}"))

        for batch in iterator:
            for row in batch.to_pylist():
                here = row["job_id"], row["export_id"]
                if any(not p or "/" in p or p.startswith(".") for p in here):
                    raise ValueError(f"no file name: {here}")
                if here != key:
                    if own is not None:
                        close()
                    key, own = here, _File(self.kind, row["columns"])
                if row["data"] is not None:
                    own.add(json.loads(row["data"]))
        if own is not None:
            close()
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = filesystem(self.root)
        for staged, place in (m for one in messages if one for m in one.moves):
            store.create_dir(place.rpartition("/")[0], recursive=True)
            store.move(staged, place)
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*filesystem(self.root))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        staging = f"{root}/.staging-{self.run}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class ExportSource(DataSource):
    """df.write.format("catalog_export").option("root", ...).option("kind", "csv" or "json"), of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "catalog_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["root"], self.options.get("kind", "csv").strip().lower())
