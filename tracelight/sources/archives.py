"""Candidate inputs: a file, a directory, or a zip, tar, tar.gz or gz container, as a DataFrame of files.

Spark's ``binaryFile`` source reads the input, so any path that Spark can open will do; containers are
taken apart in ``mapInPandas``, one container in one task, under limits.  What is not read is a row of the
``omissions`` with its reason, so an answer can tell "not there" from "not looked at".
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import text as T

NOT_SOURCE, NOT_EXAMINED = "not-source", "not-examined"


@dataclass(frozen=True)
class Limits:
    """Ceilings of one read; the defaults are those of the limits table."""

    file_bytes: int = 8 * 1024 * 1024
    entries: int = 10_000
    member_bytes: int = 64 * 1024 * 1024
    expanded_bytes: int = 2 * 1024**3
    ratio: int = 200


class Refused(ValueError):
    """An input that is stopped rather than read."""


def sniffed(content: Column) -> Column:
    """The kind of an input by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(head.startswith("1F8B"), "gzip").when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar").otherwise("file")


def member_fault(name: str) -> str | None:
    """Why an archive member is refused, or None."""
    if not name:
        return "empty entry name"
    if name.startswith(("/", "\\")):
        return "absolute entry path"
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts:
        return "parent traversal"
    if any(":" in p for p in parts):
        return "drive or scheme prefix"
    return None if parts else "resolves to the root itself"


class _Budget:
    def __init__(self, limits: Limits):
        self.limits, self.entries, self.expanded = limits, 0, 0

    def charge(self, name: str, stored: int, size: int) -> None:
        if size > self.limits.member_bytes:
            raise Refused(f"{name}: larger than a member may be")
        if stored and size // stored > self.limits.ratio:
            raise Refused(f"{name}: expands too many times over its stored size")
        self.entries, self.expanded = self.entries + 1, self.expanded + size
        if self.entries > self.limits.entries:
            raise Refused("too many entries")
        if self.expanded > self.limits.expanded_bytes:
            raise Refused("expands to too much")


def _bounded(stream, most: int) -> bytes:
    data = stream.read(most + 1)
    if len(data) > most:
        raise Refused("a member is larger than it may be")
    return data


def zip_members(content: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, None) of regular members, (name, None, note) of those left out."""
    budget = _Budget(limits)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if len(z.infolist()) > limits.entries:
            raise Refused("too many entries")
        for e in z.infolist():
            if e.is_dir():
                continue
            if fault := member_fault(e.filename):
                raise Refused(f"{e.filename}: {fault}")
            mode = e.external_attr >> 16
            if mode & 0o170000 != 0o100000:
                yield e.filename, None, "non-regular entry"
            elif e.filename.lower().endswith(T.INPUT_ARCHIVES):
                yield e.filename, None, "nested archive"
            elif e.flag_bits & 1:
                yield e.filename, None, "encrypted entry"
            else:
                budget.charge(e.filename, e.compress_size, e.file_size)
                with z.open(e) as f:
                    yield e.filename, _bounded(f, limits.member_bytes), None


def tar_members(content: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    budget = _Budget(limits)
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as t:
        for e in t:
            if e.isdir():
                continue
            if fault := member_fault(e.name):
                raise Refused(f"{e.name}: {fault}")
            if not e.isreg():
                yield e.name, None, "non-regular entry"
            elif e.name.lower().endswith(T.INPUT_ARCHIVES):
                yield e.name, None, "nested archive"
            else:
                budget.charge(e.name, 0, e.size)
                yield e.name, _bounded(t.extractfile(e), limits.member_bytes), None


def gunzip(content: bytes, limits: Limits) -> bytes:
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as g:
        data = _bounded(g, limits.expanded_bytes)
    if len(data) // max(1, len(content)) > limits.ratio:
        raise Refused("expands too many times over its stored size")
    return data


def members(kind: str, name: str, content: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """The files of one input of a kind."""
    try:
        if kind == "zip":
            yield from zip_members(content, limits)
        elif kind == "tar":
            yield from tar_members(content, limits)
        elif kind == "gzip":
            data = gunzip(content, limits)
            if data[257:262] == b"ustar":
                yield from tar_members(data, limits)
            else:
                yield name.removesuffix(".gz"), data, None
        else:
            yield name, content, None
    except (zipfile.BadZipFile, tarfile.TarError, gzip.BadGzipFile, EOFError, OSError) as e:
        raise Refused(f"unreadable: {e}") from e


def open_input(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """``path, bytes, content, note``: each file of the input once.

    ``path`` is relative to the input.  ``note`` says why a file was not read; a container that breaks a
    limit is one row with the note and no files, as if it had not been opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/")
    rel = F.when(F.instr(F.col("path"), base + "/") > 0, F.substring_index(F.col("path"), base + "/", -1)).otherwise(F.element_at(F.split("path", "/"), -1))
    raw = raw.select(rel.alias("path"), F.col("length").alias("bytes"), "content")
    top = raw.withColumn("kind", F.when(F.lit(True), sniffed(F.col("content"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, kind, content in zip(part["path"], part["kind"], part["content"]):
                try:
                    rows += [(n, len(c) if c is not None else 0, c, note) for n, c, note in members(kind, name, bytes(content), limits)]
                except Refused as e:
                    rows.append((name, len(content), None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "bytes", "content", "note"])

    return top.select("path", "kind", "content").mapInPandas(run, "path string, bytes long, content binary, note string")


def walk(opened: DataFrame, excludes: list[str], extensions: dict[str, str], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(files, omissions): files ``file, language, text``; omissions ``file, reason, kind``.

    Each path once; excluded, empty, too large and undecodable files and files without a reader are
    omissions, of which those that hold source make the answer partial.
    """
    p = T.canonical_relpath(F.col("path"))
    df = opened.withColumn("file", p).dropDuplicates(["file"])
    text = F.try_validate_utf8(F.col("content").cast("string"))
    language = F.lit(None).cast("string")
    for ext, name in extensions.items():
        language = F.when(T.extension(F.col("file")) == ext, name).otherwise(language)
    df = df.withColumn("language", language).withColumn("text", T.newlines_to_lf(T.strip_bom(text)))
    reason = (
        F.when(T.excluded(F.col("file"), excludes), "excluded")
        .when(F.col("note").isNotNull(), F.concat(F.lit("not-read: "), F.col("note")))
        .when(F.col("bytes") == 0, "empty")
        .when(T.is_archive(F.col("file")), "nested-archive")
        .when(F.col("language").isNull(), "no-adapter")
        .when(F.col("bytes") > limits.file_bytes, "too-large")
        .when(F.col("text").isNull(), "not-utf8")
    )
    judged = df.withColumn("reason", reason)
    not_examined = F.col("reason").startswith("not-read") | F.col("reason").isin("too-large", "not-utf8", "nested-archive")
    kind = F.when(not_examined, NOT_EXAMINED).otherwise(NOT_SOURCE)
    return judged.where("reason is null").select("file", "language", "text"), judged.where("reason is not null").select("file", "reason", kind.alias("kind"))


def read_tree(root) -> dict[str, str]:
    """A small tree of text files on the driver, for tests and tools."""
    from pathlib import Path

    root = Path(root)
    return {p.relative_to(root).as_posix(): p.read_text() for p in sorted(root.rglob("*")) if p.is_file()}


def write_tree(root, tree: dict[str, str]) -> None:
    from pathlib import Path

    for name, text in tree.items():
        p = Path(root) / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
