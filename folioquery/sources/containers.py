"""Containers as a source and sink: zip, gzip and tar files expanded into members where they lie, one file at a time."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events

#: What a container may expand to, as a multiple of its own size and in depth; beyond that it is set aside as a bomb, not cut.
MOST_RATIO, MOST_DEPTH = 200, 4


def members(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(container, member, content, fault) of a file, nested containers too; a file that is none is its own only member."""
    kind = "zip" if data[:4] in (b"PK\x03\x04", b"PK\x05\x06") else "gz" if data[:2] == b"\x1f\x8b" else "tar" if data[257:262] == b"ustar" else None
    if kind is None:
        yield "file", name, data, None
        return
    if depth >= MOST_DEPTH:
        yield kind, name, None, "nested too deep"
        return
    try:
        limit = MOST_RATIO * len(data) + 1_000_000
        if kind == "gz":
            with gzip.open(io.BytesIO(data)) as f:
                inner = f.read(limit + 1)
            found = [(name.removesuffix(".gz"), inner)]
        elif kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if sum(i.file_size for i in z.infolist()) > limit:
                    raise OverflowError
                found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                found = [(i.name, t.extractfile(i).read()) for i in t.getmembers() if i.isfile()]
        if sum(len(c) for _, c in found) > limit:
            raise OverflowError
    except OverflowError:
        yield kind, name, None, "expands beyond its limit"
        return
    except Exception as e:  # a broken container is one row, not a failed job
        yield kind, name, None, type(e).__name__
        return
    for member, content in found:
        for inner_kind, inner_name, inner, fault in members(member, content, depth + 1):
            yield kind if inner_kind == "file" else inner_kind, inner_name, inner, fault


def expand(spark: SparkSession, path: str) -> DataFrame:
    """(path, container, member, content, fault): the members of the files under a folder; a file is expanded in the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in members(os.path.basename(source), data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((source, *row), (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))], names=["path", "container", "member", "content", "fault"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, container string, member string, content binary, fault string")


def pack(docs: DataFrame, path: str) -> int:
    """Write (doc_id, text) as containers, a zip of the even and a gzip of the odd ids per few hundred rows; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        folder = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            written, rows = 0, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            even = [r for r in rows if r[0] % 2 == 0]
            for i in range(0, len(even), 256):
                with zipfile.ZipFile(f"{folder}/{uuid4().hex}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                    for doc, text in even[i : i + 256]:
                        z.writestr(f"doc-{doc}.txt", text.encode())
                written += 1
            # A gzip of a tar of the odd ids: two containers, one inside the other.
            odd = [r for r in rows if r[0] % 2]
            for i in range(0, len(odd), 256):
                inner = io.BytesIO()
                with tarfile.open(fileobj=inner, mode="w") as t:
                    for doc, text in odd[i : i + 256]:
                        info = tarfile.TarInfo(f"doc-{doc}.txt")
                        info.size = len(text.encode())
                        t.addfile(info, io.BytesIO(text.encode()))
                with gzip.open(f"{folder}/{uuid4().hex}.tar.gz", "wb") as f:
                    f.write(inner.getvalue())
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    return docs.select("doc_id", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def roundtrip(docs: DataFrame) -> DataFrame:
    """(doc_id, member, container, bytes) of documents packed into the shared folder and expanded again."""
    spark = docs.sparkSession
    path = events.work_dir(spark) + "/containers"
    pack(docs, path)
    found = expand(spark, path).where("fault IS NULL")
    kind = F.when(F.endswith("path", F.lit(".zip")), "zip").otherwise("gz")
    # A task that ran twice has written its files twice; a member counts once.
    return found.select(F.regexp_extract("member", r"doc-(\d+)\.txt", 1).cast("bigint").alias("doc_id"), "member", kind.alias("container"), F.octet_length("content").cast("bigint").alias("bytes")).distinct()
