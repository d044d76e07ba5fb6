"""A data source for index artifacts: small binary files of typed sections.

Layout of a file: three unsigned 32-bit numbers (magic, length of the header, start of the sections), a JSON header with the
format's version, a build's name and each section's place and size, then the sections, each from a multiple of eight bytes on.
Files are written to and read from any file system that pyarrow knows by its URI, one partition a file; a job's files get
their names only when all tasks have ended well, so a failed job leaves none.

    spark.dataSource.register(artifacts.ArtifactSource)
    rows.write.format("sections").mode("overwrite").option("build", "b1").save(folder)     # rows: name, kind, data
    spark.read.format("sections").option("build", "b1").load(folder)                       # file, name, kind, data

A wrong magic, an unknown version, a section that goes past the file's end, a section whose size its kind doesn't divide and
another build than the wanted one are errors that name the file. ``float32`` packs vectors to a section's bytes and back.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Magic and versions of the format, and bytes of an element of each kind of section.
MAGIC, VERSIONS = 0x43494458, (1, 2)
SIZES = {"json": 1, "int8": 1, "bits": 1, "u32": 4, "f32": 4}
ALIGNED = 8


class ArtifactError(ValueError):
    """A file that isn't a whole artifact."""


def _up(n: int) -> int:
    return -(-n // ALIGNED) * ALIGNED


def pack(sections: list[tuple[str, str, bytes]], build: str, version: int = VERSIONS[-1]) -> bytes:
    """A file of (name, kind, data)."""
    places, at = {}, 0
    for name, kind, data in sections:
        if kind not in SIZES or name in places:
            raise ArtifactError(f"section {name} is of unknown kind {kind} or there twice")
        if len(data) % SIZES[kind]:
            raise ArtifactError(f"section {name} isn't made of whole {kind} elements")
        places[name], at = {"kind": kind, "at": at, "size": len(data)}, _up(at + len(data))
    header = json.dumps({"formatVersion": version, "buildId": build, "sections": places}).encode()
    start = _up(12 + len(header))
    out = bytearray(start + at)
    struct.pack_into("<III", out, 0, MAGIC, len(header), start)
    out[12 : 12 + len(header)] = header
    for name, _, data in sections:
        a = start + places[name]["at"]
        out[a : a + len(data)] = data
    return bytes(out)


def unpack(data: bytes, build: str | None = None) -> list[tuple[str, str, bytes]]:
    """(name, kind, data) of a file, in order of their places."""
    if len(data) < 12:
        raise ArtifactError("cut before its header")
    magic, length, start = struct.unpack_from("<III", data)
    if magic != MAGIC:
        raise ArtifactError("not an artifact: wrong magic")
    if 12 + length > min(start, len(data)):
        raise ArtifactError("cut within its header")
    header = json.loads(data[12 : 12 + length])
    if header.get("formatVersion") not in VERSIONS:
        raise ArtifactError(f"unknown version {header.get('formatVersion')}")
    if build is not None and header.get("buildId") != build:
        raise ArtifactError(f"of build {header.get('buildId')}, not {build}")
    out = []
    for name, s in sorted(header["sections"].items(), key=lambda x: (x[1]["at"], x[0])):
        a = start + s["at"]
        if a + s["size"] > len(data):
            raise ArtifactError(f"cut within section {name}")
        if s["size"] % SIZES.get(s["kind"], 1):
            raise ArtifactError(f"section {name} isn't made of whole {s['kind']} elements")
        out.append((name, s["kind"], data[a : a + s["size"]]))
    return out


def packed_float32(vector: Column) -> Column:
    """An array of numbers as little-endian 32-bit floats."""
    return F.pandas_udf(lambda vs: vs.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary")(vector.cast("array<double>"))


def unpacked_float32(data: Column) -> Column:
    """Floats of a section; bytes that aren't whole floats are an error."""

    def floats(b: bytes | None) -> np.ndarray | None:
        if b is not None and len(b) % 4:
            raise ArtifactError("not made of whole f32 elements")
        return None if b is None else np.frombuffer(b, "<f4").astype(float)

    return F.pandas_udf(lambda bs: bs.map(floats), "array<double>")(data)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.build = options["path"], options.get("build")

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, path = _system(self.path)
        found = system.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.extension == "bin" and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, _ = _system(self.path)
        with system.open_input_stream(partition.path) as stream:
            data = stream.read()
        try:
            rows = unpack(data, self.build)
        except ArtifactError as error:
            raise ArtifactError(f"{partition.path}: {error}") from None
        for name, kind, section in rows:
            yield partition.path.rsplit("/", 1)[-1], name, kind, section


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.build, self.version = options["path"], options.get("build", ""), int(options.get("version", VERSIONS[-1]))
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        sections = [(r["name"], r["kind"], bytes(r["data"])) for r in rows]
        if not sections:
            return _Written("")
        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/_{self.job}-{uuid.uuid4().hex}"
        with system.open_output_stream(name) as stream:
            stream.write(pack(sections, self.build, self.version))
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.extension == "bin"] if self.overwrite else []
        for i, message in enumerate(m for m in messages if m and m.path):
            system.move(message.path, f"{path}/part-{i:05d}-{self.job}.bin")
        for name in old:
            system.delete_file(name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _system(self.path)
        for message in messages:
            if message and message.path:
                system.delete_file(message.path)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return "file string, name string, kind string, data binary"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options, overwrite)
