"""Files on any file system: what executors write, sweep and read beyond Spark's own file sources."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a line file that one task reads.
SPLIT = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or an address with a scheme."""
    path = path.removeprefix("file://") if path.startswith("file://") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def write_files(rows: DataFrame, root: str, name: str = "name", text: str = "text") -> DataFrame:
    """(name, written): every row as a file below ``root``, written by the executor that holds it, and only if it changed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for batch in batches:
            done = []
            for path, said in zip(batch["name"], batch["text"]):
                target, data = f"{base}/{path}", said.encode("utf-8")
                info = system.get_file_info(target)
                if info.type == fs.FileType.File and info.size == len(data):
                    with system.open_input_stream(target) as old:
                        if old.read() == data:
                            done.append((path, False))
                            continue
                system.create_dir(os.path.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"  # a reader never sees half of a file, nor a second try the first one's
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, target)
                done.append((path, True))
            yield pd.DataFrame(done, columns=["name", "written"])

    return rows.select(rows[name].alias("name"), rows[text].alias("text")).mapInPandas(run, "name string, written boolean")


def listed(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(name): files below ``root``, as a file source lists them."""
    system, base = opened(root)
    infos = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return spark.createDataFrame([(i.path[len(base):].lstrip("/"),) for i in infos if i.type == fs.FileType.File and i.path.endswith(suffix)], "name string")


def remove_files(names: DataFrame, root: str) -> DataFrame:
    """(name): the files that executors took away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for batch in batches:
            for name in batch["name"]:
                if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{base}/{name}")
            yield batch[["name"]]

    return names.select("name").mapInPandas(run, "name string")


class LineSource(DataSource):
    """``spark.read.format("lines").load(path)``: (line, at) of one file that Spark's sources pass over, read in byte ranges.

    ``at`` is the byte at which a line begins, so an error can name its place.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "line string, at bigint"

    def reader(self, schema) -> "LineReader":
        return LineReader(self.options["path"])


class LineReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, inner = opened(self.path)
        size = system.get_file_info(inner).size or 0
        return [InputPartition((start, min(start + SPLIT, size))) for start in range(0, size, SPLIT)] or [InputPartition((0, 0))]

    def read(self, partition):
        start, stop = partition.value
        if stop <= start:
            return
        system, inner = opened(self.path)
        with system.open_input_file(inner) as file:
            at = max(0, start - 1)
            file.seek(at)
            lines = _lines(file, at)
            if start:  # the line that the split falls into belongs to the one before, unless it begins here
                first = next(lines, None)
                if first is None:
                    return
            for begin, line in lines:
                if begin >= stop:
                    return
                yield line.decode("utf-8", "replace"), begin


def _lines(file, at: int) -> Iterator[tuple[int, bytes]]:
    rest = b""
    while chunk := file.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def line_at(path: str, at: int) -> int:
    """Number of the line that begins at a byte, counted in a stream."""
    system, inner = opened(path)
    number, left = 1, at
    with system.open_input_stream(inner) as file:
        while left > 0 and (chunk := file.read(min(left, 1 << 20))):
            number += chunk.count(b"\n")
            left -= len(chunk)
    return number


def flavor(root: str, default: str = "vscode") -> str:
    """The way of rendering that a collection recorded."""
    system, base = opened(root)
    if not exists(f"{root}/.quarry.json"):
        return default
    with system.open_input_stream(f"{base}/.quarry.json") as state:
        return json.loads(state.read().decode("utf-8")).get("flavor", default)


def init_collection(root: str, name: str = "vscode") -> None:
    """Make an empty collection with its index and its way of rendering; an existing one is refused."""
    if name not in ("vscode", "obsidian"):
        raise ValueError(f"no such flavor: {name}")
    if exists(f"{root}/.quarry.json"):
        raise FileExistsError(f"there is a collection at {root}")
    system, base = opened(root)
    system.create_dir(base, recursive=True)
    for file, said in ((".quarry.json", json.dumps({"flavor": name}) + "\n"), ("INDEX.md", "| Title | Authors | Year | Journal | About |\n|-|-|-|-|-|\n"), (".gitignore", "*.rendered.md\n")):
        if not exists(f"{root}/{file}"):
            with system.open_output_stream(f"{base}/{file}") as out:
                out.write(said.encode("utf-8"))
