"""TeX sources: archives read on executors, the main file chosen, inputs put in their places."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 8
TEXT = (".tex", ".bib", ".bbl", ".ltx")
INPUT = re.compile(r"\\(?:input|include)\s*\{([^}]+)\}|\\input\s+([^\s{}\\]+)")


def decoded(data: bytes) -> str:
    """UTF-8, and Latin-1 where it is not."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def members(data: bytes) -> dict[str, str]:
    """Text files of a source: a tar archive, a packed or a plain TeX file.

    PDF is refused, and so is an archive with a link or a path that leaves it.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:5] == b"%PDF-":
        raise ValueError("the source is a PDF")
    try:
        archive = tarfile.open(fileobj=io.BytesIO(data))
    except tarfile.ReadError:
        return {"main.tex": decoded(data)} if data.strip() else {}
    out = {}
    for member in archive:
        path = posixpath.normpath(member.name)
        if member.issym() or member.islnk() or path.startswith(("/", "..")):
            raise ValueError(f"the archive leaves its folder: {member.name}")
        if member.isfile() and path.lower().endswith(TEXT):
            out[path] = decoded(archive.extractfile(member).read())
    return out


def _resolved(name: str, base: str, held: dict[str, str]) -> str | None:
    for folder in dict.fromkeys((base, "")):
        for path in (name, name + ".tex"):
            if (full := posixpath.normpath(posixpath.join(folder, path))) in held:
                return full
    return None


def main_file(held: dict[str, str]) -> str | None:
    """The file with a document class that no other takes in; of several the longest, then the first by name."""
    taken = {r for path, text in held.items() for m in INPUT.finditer(text) if (r := _resolved((m[1] or m[2]).strip(), posixpath.dirname(path), held))}
    own = [p for p in held if p.endswith((".tex", ".ltx")) and p not in taken] or [p for p in held if p.endswith((".tex", ".ltx"))]
    classed = [p for p in own if re.search(r"\\document(?:class|style)\b", held[p])] or own
    return min(classed, key=lambda p: (-len(held[p]), p), default=None)


def inlined(path: str, held: dict[str, str], depth: int = 0) -> str:
    """A file with its inputs in their places, ``DEPTH`` levels deep; an unknown input stays as it is written."""
    def put(m: re.Match) -> str:
        other = _resolved((m[1] or m[2]).strip(), posixpath.dirname(path), held)
        return inlined(other, held, depth + 1) if other and depth < DEPTH else m.group()

    return INPUT.sub(put, held[path])


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, main, source, bibliography, error): one row for each source archive of a pattern, opened on executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    held = members(bytes(content))
                    main = main_file(held)
                    listed = "\n".join(held[p] for p in sorted(held) if p.endswith((".bib", ".bbl")))
                    rows.append((path, main, inlined(main, held) if main else None, listed, None if main else "no TeX file"))
                except (ValueError, OSError, EOFError, tarfile.TarError) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "main", "source", "bibliography", "error"])

    rows = spark.read.format("binaryFile").load(pattern).select(F.col("path"), F.col("content"))
    return rows.mapInPandas(run, "path string, main string, source string, bibliography string, error string")
