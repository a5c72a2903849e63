"""Members of ZIP and TAR archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenset.operators.manifest import EXTENSIONS


def _zip_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, z.read(m)
    except (zipfile.BadZipFile, EOFError):
        return


def _tar_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    except (tarfile.TarError, EOFError):
        return


def archive_members(spark: SparkSession, path: str, kind: str = "zip", extensions: tuple[str, ...] | None = EXTENSIONS, first: int | None = None) -> DataFrame:
    """(``archive``, ``member``, ``nth``, ``content``) of the members with one of the extensions (all, with None).

    One task reads one archive and hands its members on one by one. A broken archive gives the members before the break; ``first``
    stops reading each archive after so many.
    """
    members = {"zip": _zip_members, "tar": _tar_members}[kind]
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("nth", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                n = 0
                for name, data in members(content):
                    if extensions is not None and name.rsplit(".", 1)[-1].lower() not in extensions:
                        continue
                    if first is not None and n >= first:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((where, name, n, data), schema)], schema=schema)
                    n += 1

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, "archive string, member string, nth long, content binary")
