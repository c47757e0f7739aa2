"""Source trees: files listed and read in tasks, a tree at a time, so that many trees are spread over the cluster."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.graph import cut
from sparkloom.sources import ignore

#: Folders that are never walked, suffixes of sources, and bounds in bytes.
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage")
SUFFIXES = (".ts", ".tsx", ".js", ".jsx")
FILE_BYTES, TREE_BYTES = 8 << 20, 256 << 20
LISTED = pa.schema([("project_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("bytes", pa.int64())])
#: Comments, and import and export-from statements with their specifier.
COMMENT = r"(?s)/\*.*?\*/|(?m)^\s*//[^\n]*"
IMPORT = r"""(?m)^\s*(?:(?:import|export)\b[^'";]*?from|import)\s*['"]([^'"]+)['"]"""


def walk(root: str) -> Iterator[tuple[str, int]]:
    """Path and size of the files below ``root``; skipped folders aren't entered and links aren't followed."""
    store, base = fs.FileSystem.from_uri(root)
    local, todo = isinstance(store, fs.LocalFileSystem), [base.rstrip("/")]
    while todo:
        for info in store.get_file_info(fs.FileSelector(todo.pop())):
            if local and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory and info.base_name not in SKIPPED:
                todo.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path[len(base.rstrip("/")) + 1 :], info.size


def listed(roots: DataFrame) -> DataFrame:
    """``project_id, root, path, bytes`` of the files of ``roots(project_id, root)``, a tree at a time in each task.

    Spark's own file sources pass over names that begin with a dot or an underscore, which source trees are full of, so
    trees are listed by Arrow's file systems; a root has to be in reach of all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(walk(root))
                yield pa.RecordBatch.from_pydict({"project_id": [project] * len(found), "root": [root] * len(found), "path": [p for p, _ in found], "bytes": [n for _, n in found]}, LISTED)

    return roots.select("project_id", "root").mapInArrow(run, "project_id string, root string, path string, bytes long")


def with_content(files: DataFrame) -> DataFrame:
    """``files(project_id, root, path, bytes)`` with their ``content``, read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(row["root"])
                with store.open_input_stream(f"{base.rstrip('/')}/{row['path']}") as f:
                    yield pa.RecordBatch.from_pylist([row | {"content": f.read()}], LISTED.append(pa.field("content", pa.binary())))

    return files.select("project_id", "root", "path", "bytes").mapInArrow(run, "project_id string, root string, path string, bytes long, content binary")


def discover_trees(roots: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, gitignore: bool = True) -> DataFrame:
    """``project_id, path, content_hash, bytes, text`` of the source files of many trees.

    What is kept is listed and judged before any of it is read: too large files or trees raise.
    """
    every = listed(roots)
    files = every.filter(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    if gitignore:
        rules = with_content(every.filter(F.col("path").rlike(rf"(^|/){re.escape(ignore.NAME)}$")))
        rules = rules.select("project_id", F.regexp_replace("path", f"/?{re.escape(ignore.NAME)}$", "").alias("dir"), F.col("content").cast("string").alias("text"))
        files = ignore.with_ignored(files, rules).filter("NOT ignored").drop("ignored")
    files = cut(files, "files")  # listed once, so what is read is what was judged
    size = files.groupBy("project_id").agg(F.max("bytes").alias("file"), F.sum("bytes").alias("tree")).agg(F.max("file"), F.max("tree")).first()
    if (size[0] or 0) > FILE_BYTES or (size[1] or 0) > TREE_BYTES:
        raise ValueError(f"a file of {size[0]} or a tree of {size[1]} bytes is above the bounds")
    return with_content(files).select("project_id", "path", F.sha2("content", 256).alias("content_hash"), "bytes", F.col("content").cast("string").alias("text"))


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, gitignore: bool = True) -> DataFrame:
    """``path, content_hash, bytes, text`` of one tree's source files, in the order of paths."""
    return discover_trees(spark.createDataFrame([("", root)], "project_id string, root string"), suffixes, gitignore).drop("project_id").orderBy("path")


def imports_of(files: DataFrame, *kept: Column | str) -> DataFrame:
    """``importer_path, specifier`` of the import and re-export statements in ``files(path, text)``, and what is kept."""
    return files.select(*kept, F.col("path").alias("importer_path"), F.explode(F.regexp_extract_all(F.regexp_replace("text", COMMENT, ""), F.lit(IMPORT), F.lit(1))).alias("specifier"))
