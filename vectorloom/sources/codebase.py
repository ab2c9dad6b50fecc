"""A directory tree of source files as rows, by a Python data source: the driver lists paths, tasks read files.

Spark's own file readers leave out names that begin with ``_`` or ``.``; this source keeps ``__init__.py``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectorloom.types import EXTRACTED

# Extensions read by default, and parts of a path that leave a file out.
EXTENSIONS = (
    "rs", "py", "js", "ts", "java", "go", "cpp", "c", "h", "hpp", "rb", "php", "swift", "kt", "scala", "r", "md", "txt",
    "toml", "yaml", "yml", "json", "xml", "html", "css", "sh", "bash",
)
SKIPPED = (
    "/.git/", "/.github/", "/.vscode/", "/.idea/", "/.cargo/", "/target/", "/node_modules/", "/vendor/", "/dist/", "/build/",
    "/__pycache__/", "/.mypy_cache/", "/.pytest_cache/",
)
MAX_BYTES = 1024 * 1024
_FILES_PER_TASK = 256


def wanted(path: Column, extensions=EXTENSIONS) -> Column:
    """The same choice by path as an expression: no skipped directory, no dot file, one of the extensions."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.instr(F.substring(name, 2, 10_000), ".") > 0
    extension = F.when(dotted, F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))
    skipped = F.lit(False)
    for part in SKIPPED:
        skipped = skipped | F.contains(path, F.lit(part))
    return ~skipped & ~F.startswith(name, F.lit(".")) & extension.isin(list(extensions))


def _is_wanted(path: str, extensions: frozenset[str]) -> bool:
    name = os.path.basename(path)
    return not name.startswith(".") and not any(p in path for p in SKIPPED) and os.path.splitext(name)[1][1:] in extensions


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = frozenset(x for x in options.get("extensions", ",".join(EXTENSIONS)).split(",") if x)
        self.most = int(options.get("maxfilesize", options.get("maxFileSize", MAX_BYTES)))

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder, subfolders, names in os.walk(self.root):
            subfolders.sort()
            found += [p for n in sorted(names) if _is_wanted(p := os.path.join(folder, n), self.extensions) and not os.path.islink(p)]
        return [_Files(found[k : k + _FILES_PER_TASK]) for k in range(0, len(found), _FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                if os.path.getsize(path) > self.most:
                    continue
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            yield content, os.path.relpath(path, self.root), {"format": "code", "extension": os.path.splitext(path)[1][1:], "path": path}


class CodebaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self):
        return EXTRACTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_codebase(spark: SparkSession, root: str, extensions: list[str] | None = None, max_file_size: int = MAX_BYTES) -> DataFrame:
    """(content, source, metadata) of the files below ``root``, which all executors must see."""
    spark.dataSource.register(CodebaseSource)
    reader = spark.read.format("codebase").option("maxFileSize", str(max_file_size))
    if extensions is not None:
        reader = reader.option("extensions", ",".join(extensions))
    return reader.load(root)
