"""Data sources that read parts of one file in many tasks: members of archives by byte ranges, layers of GeoPackages by rowids.

A file is listed and opened by its own store (``pyarrow.fs``) when reading is planned, for its directory alone; a task opens
it anew and reads its part as a stream, so no file is ever held whole.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def places_for(path: str) -> list[tuple[object, str, str]]:
    """Store and place of a file to be written, its folder made."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return [(store, place, place)]


def files_at(path: str) -> list[tuple[object, str, str]]:
    """Store, place in it and full name of the files at a path, which may be a folder or hold ``*``."""
    import fnmatch

    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if "*" in place:
        folder = place[: place.index("*")].rpartition("/")[0] or "/"
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and fnmatch.fnmatch(f.path, place)]
    elif store.get_file_info(place).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    else:
        found = [place]
    return [(store, p, p) for p in sorted(found)]


@dataclass
class Range(InputPartition):
    file: str
    member: str
    low: int
    high: int


def member_of(names: list[str], wanted: str) -> str | None:
    """The first member of that name, or of that name in a folder."""
    return next((n for n in names if n == wanted or n.endswith(f"/{wanted}")), None)


def records(stream: io.BufferedReader, low: int, high: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """``(number, record)`` of the CSV records that begin at bytes ``low`` to ``high`` of a stream; line ends within quotes
    belong to their record. What comes before is only searched for quotes and line ends."""
    at, number, open_, fresh = 0, 0, False, True
    while at < low:
        data = stream.read(min(chunk, low - at))
        if not data:
            return
        at += len(data)
        parts = data.split(b'"')
        for i, part in enumerate(parts):
            if not (open_ ^ (i % 2 == 1)):
                number += part.count(b"\n")
        open_ ^= len(parts) % 2 == 0
        fresh = not open_ and data.endswith(b"\n")
    record, begun, ours = b"", at, fresh
    for line in stream:
        record += line
        at += len(line)
        open_ ^= line.count(b'"') % 2 == 1
        if open_:
            continue
        if ours:
            if begun >= high:
                return
            yield number, record
        number += 1
        record, begun, ours = b"", at, True
        if begun >= high:
            return
    if record and ours and begun < high:
        yield number, record


class MemberReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.member = options["path"], options["member"]
        self.optional, self.split = options.get("optional") == "true", int(options.get("split", 64 << 20))
        self.columns = [f.name for f in schema.fields][2:]

    def partitions(self) -> list[Range]:
        out = []
        for store, place, name in files_at(self.path):
            with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                found = member_of(z.namelist(), self.member)
                if found is None and not self.optional:
                    raise ValueError(f"{name} has no {self.member}")
                if found is not None:
                    size = max(1, z.getinfo(found).file_size)
                    out += [Range(name, found, low, min(low + self.split, size)) for low in range(0, size, self.split)]
        return out

    def read(self, part: Range):
        if part is None:  # there is no file with the member
            return
        (store, place, name), *_ = files_at(part.file if ":" not in self.path else f"{self.path.partition(':')[0]}:{part.file}")
        fields = lambda record: next(csv.reader(io.StringIO(record.decode("utf-8-sig"), newline="")), [])
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
            with z.open(part.member) as stream:
                head = [h.strip() for h in fields(next(records(stream, 0, 1), (0, b""))[1])]
            at = [head.index(c) if c in head else None for c in self.columns]
            with z.open(part.member) as stream:
                for number, record in records(stream, part.low, part.high):
                    line = fields(record) if number else []
                    if line:
                        yield (part.file, number - 1, *[line[i].strip() if i is not None and i < len(line) else None for i in at])


class ArchiveMember(DataSource):
    """``spark.read.format("archive_member").option("member", "stops.txt").schema("archive string, pos long, …")``."""

    @classmethod
    def name(cls) -> str:
        return "archive_member"

    def schema(self) -> str:
        raise ValueError("name the columns of the member in a schema")

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options, schema)


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer, self.split = options["path"], options["layer"], int(options.get("split", 100_000))
        self.kinds = tuple(options["kinds"].split(","))

    def partitions(self) -> list[Range]:
        out = []
        for _, place, name in files_at(self.path):
            db = database(place)
            table = layer_of([t for (t,) in db.execute("SELECT table_name FROM gpkg_contents")], self.layer)
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
            db.close()
            if low is not None:
                out += [Range(name, table, at, min(at + self.split - 1, high)) for at in range(low, high + 1, self.split)]
        return out

    def read(self, part: Range):
        from viaduct.sources.feeds import geopackage_payload, wkb_lines

        if part is None:
            return
        db = database(part.file)
        for row, geometry, kind in db.execute(f'SELECT rowid, geom, fclass FROM "{part.member}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high)):
            if kind in self.kinds:
                for n, line in enumerate(wkb_lines(geopackage_payload(geometry))):
                    yield f"{part.file}#{row}", n, line
        db.close()


def database(place: str):
    """The file opened where it lies, for reading alone."""
    import sqlite3
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(place)}?mode=ro&immutable=1", uri=True)


def layer_of(tables: list[str], wanted: str) -> str:
    """The layer of that very name, else the first that begins so."""
    fit = sorted(t for t in tables if t.startswith(wanted))
    if not fit:
        raise ValueError(f"no {wanted} layer")
    return wanted if wanted in fit else fit[0]


class GeoPackageLayer(DataSource):
    """Lines of one layer whose class is one of ``kinds``, ``split`` rowids a task. Files lie on a mounted store."""

    @classmethod
    def name(cls) -> str:
        return "geopackage_layer"

    def schema(self) -> str:
        return "file string, n int, p array<struct<lat:double,lon:double>>"

    def reader(self, schema: StructType) -> LayerReader:
        return LayerReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ArchiveMember)
    spark.dataSource.register(GeoPackageLayer)
