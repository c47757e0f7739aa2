"""A store of tables by key (a project, a queue): copy-on-write snapshots, and commits by compare-and-set.

``<root>/<table>/snapshot=<id>/<key>=<value>`` holds what one write made. A manifest row says which snapshot holds a
key's rows, so a commit that replaces one key writes that key's folders and one row, and takes over all other folders
unread. Commits are numbered files. The next number is created only where it doesn't exist yet, whole or not at all; a
writer that comes second looks at what was committed and tries the number after. Readers fold the manifests of the
commits that they saw, so they see all of a commit or nothing of it. Every ``COMPACT`` commits the folded manifest is
written out, which bounds what a reader folds.

Folders that no manifest names stay, as does what a writer left that died before its commit; nothing reads them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.plans.graph import Graph

COMMIT = "seq long, manifest string, whole boolean, schemas map<string, string>"
#: Commits after which a writer folds the manifests into one.
COMPACT = 16


class ConflictError(RuntimeError):
    """What a change was based on has been replaced by others, in every attempt."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text unless the path exists; False where it does.

    A draft gets the final name by a link (local file systems) or a rename that doesn't overwrite (HDFS and others),
    both of which let one of several writers win.
    """
    draft, place = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}", urlparse(path)
    if place.scheme in ("", "file"):
        final, draft = place.path, urlparse(draft).path
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    out = at(draft).getFileSystem(conf).create(at(draft), True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), conf).rename(at(draft), at(path), options)
    except Py4JJavaError as e:
        at(draft).getFileSystem(conf).delete(at(draft), False)
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    return True


@dataclass(frozen=True)
class View:
    """What is in force after commit ``seq`` (0: none): ``manifest(<key>, snapshot, tables)`` and the tables' schemas.

    ``tables`` are those that the snapshot has; a key has no rows in others.
    """

    seq: int
    manifest: DataFrame
    schemas: dict[str, StructType]
    folded: int

    def held(self, key: str, keys: Iterable[str]) -> dict[str, str]:
        """The snapshots of some keys; those that hold nothing are left out."""
        return {r[0]: r[1] for r in self.manifest.filter(F.col(key).isin(*keys)).select(key, "snapshot").collect()}


class Store:
    """Tables below ``root`` that all have the string column ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "project_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.entry = f"{key} string, snapshot string, tables array<string>"
        # Not by an empty write: writers of one folder share its temporary one, which the first to end deletes.
        commits = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        commits.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(commits)

    def view(self, seq: int | None = None) -> View:
        """The latest state, or that after commit ``seq``."""
        log = self.spark.read.schema(COMMIT).json(f"{self.root}/commits")
        log = log if seq is None else log.filter(F.col("seq") <= seq)
        whole = log.filter("whole").agg(F.max("seq")).first()[0] or 0
        rows = log.filter(F.col("seq") >= whole).orderBy("seq").collect()  # COMPACT rows or so
        none = self.spark.createDataFrame([], self.entry + ", seq long")
        parts = [self.spark.read.schema(self.entry).parquet(f"{self.root}/manifest/{r.manifest}").withColumn("seq", F.lit(r.seq)) for r in rows]
        folded = reduce(DataFrame.unionByName, parts, none).groupBy(self.key).agg(F.max_by(F.struct("snapshot", "tables"), "seq").alias("m")).select(self.key, "m.*").filter("snapshot IS NOT NULL")
        schemas = {t: StructType.fromJson(json.loads(s)) for r in rows for t, s in r.schemas.items()}
        return View(rows[-1].seq if rows else 0, folded, schemas, len(rows))

    def read(self, view: View | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of a view; with ``keys`` only their folders are read."""
        view = view or self.view()
        out = {}
        held = None if keys is None else view.held(self.key, keys)
        known = view.manifest if held is None else view.manifest.filter(F.col(self.key).isin(*held))
        written = [(r.snapshot, r.tables) for r in known.select("snapshot", "tables").distinct().collect()]
        for table, schema in view.schemas.items():
            live = sorted(s for s, tables in written if table in tables)
            if not live:
                out[table] = self.spark.createDataFrame([], schema)
                continue
            every = self.folders(table, schema, live)
            if held is None:
                every = every.join(view.manifest, [self.key, "snapshot"], "left_semi")
            else:
                every = every.filter(reduce(lambda a, b: a | b, ((F.col("snapshot") == s) & F.col(self.key).isin(*(k for k in held if held[k] == s)) for s in live)))
            out[table] = every.select(*schema.names)
        return out

    def folders(self, table: str, schema: StructType, snapshots: list[str]) -> DataFrame:
        """A table's rows in some snapshots, with ``snapshot``."""
        typed = StructType([*schema.fields, StructField("snapshot", StringType())])
        return self.spark.read.schema(typed).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/snapshot={s}" for s in snapshots))

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write rows as a new snapshot, which nobody sees yet."""
        name = uuid.uuid4().hex
        for table, df in tables.items():  # rebalancing splits a key that is too large for a task
            df.hint("rebalance", self.key).write.partitionBy(self.key).parquet(f"{self.root}/{table}/snapshot={name}")
        return name

    def commit(self, entries: DataFrame, schemas: dict[str, StructType], whole: bool = False, based_on: dict[str, str | None] | None = None) -> int | None:
        """Put ``entries(<key>, snapshot, tables)`` in force, null for keys to be dropped; ``whole`` drops all others.

        Returns the commit's number, or None if a key of ``based_on`` no longer has the snapshot given there.
        """
        entries.coalesce(1).write.parquet(f"{self.root}/manifest/{(name := uuid.uuid4().hex)}")
        while True:  # a lost race is another writer's commit
            view, manifest, all_keys = self.view(), name, whole
            if based_on is not None:
                held = view.held(self.key, based_on)
                if any(held.get(k) != s for k, s in based_on.items()):
                    return None
            if view.folded >= COMPACT and not whole:
                manifest, all_keys = uuid.uuid4().hex, True
                view.manifest.join(entries, self.key, "left_anti").unionByName(entries.filter("snapshot IS NOT NULL")).write.parquet(f"{self.root}/manifest/{manifest}")
            every = {**view.schemas, **schemas}
            record = {"seq": view.seq + 1, "manifest": manifest, "whole": all_keys, "schemas": {t: s.json() for t, s in every.items()}}
            if create_once(self.spark, f"{self.root}/commits/{view.seq + 1:020d}.json", json.dumps(record)):
                return view.seq + 1

    def entries(self, tables: dict[str, DataFrame], keys: list[str] | None, snapshot: str) -> DataFrame:
        """Manifest rows of what was written: for the keys given, or for those that have rows."""
        if keys is not None:
            return self.spark.createDataFrame([(k, snapshot, list(tables)) for k in keys], self.entry)
        paths = [self.folders(t, df.schema, [snapshot]).select(self.key) for t, df in tables.items()]
        return reduce(DataFrame.unionByName, paths).distinct().withColumns({"snapshot": F.lit(snapshot), "tables": F.array(*map(F.lit, tables))})

    def replace(self, tables: dict[str, DataFrame], keys: list[str] | None = None, whole: bool = False) -> int:
        """Replace all rows of ``keys`` (or of the keys that have rows) in all tables; ``whole``: of all keys."""
        if keys is not None:
            tables = {t: df.filter(F.col(self.key).isin(*keys)) for t, df in tables.items()}
        snapshot = self.write(tables)
        return self.commit(self.entries(tables, keys, snapshot), {t: df.schema for t, df in tables.items()}, whole)

    def update(self, keys: list[str], change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = 100) -> int:
        """Replace the rows of ``keys`` by what ``change`` makes of them; it runs again where others came first."""
        for _ in range(attempts):
            view = self.view()
            held = view.held(self.key, keys)
            made = change(self.read(view, keys))
            made = {t: df.filter(F.col(self.key).isin(*keys)) for t, df in made.items()}
            snapshot = self.write(made)
            done = self.commit(self.entries(made, keys, snapshot), {t: df.schema for t, df in made.items()}, based_on={k: held.get(k) for k in keys})
            if done is not None:
                return done
        raise ConflictError(f"{attempts} attempts lost to other writers")


TABLES = ("node", "edge", "tail", "payload")


def graph_tables(g: Graph) -> dict[str, DataFrame]:
    return {t: df for t, df in zip(TABLES, (g.nodes, g.edges, g.tail, g.payload), strict=True) if df is not None}


def save(g: Graph, root: str) -> int:
    """Replace all projects below ``root`` by those of ``g``; returns the commit's number."""
    return Store(g.nodes.sparkSession, root).replace(graph_tables(g), whole=True)


def save_project(g: Graph, root: str, project_id: str) -> int:
    """Replace one project's rows by its rows of ``g``; folders of other projects are neither read nor written."""
    return Store(g.nodes.sparkSession, root).replace(graph_tables(g), [project_id])


def load(spark: SparkSession, root: str, project_id: str | None = None, seq: int | None = None) -> Graph:
    """The latest graph, or that after commit ``seq``; of one project, if named."""
    store = Store(spark, root)
    tables = store.read(store.view(seq), None if project_id is None else [project_id])
    if not tables:
        raise FileNotFoundError(f"{root} holds no graph")
    return Graph(*(tables.get(t) for t in TABLES))
