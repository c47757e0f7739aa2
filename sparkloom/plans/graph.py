"""The graph as DataFrames, its vocabularies and checks, and lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Closed sets of kinds.
NODE_KINDS = ("repo", "package", "file", "symbol", "callSite")
DEPENDENCIES = ("imports", "references", "calls", "extends", "implements")
EDGE_KINDS = ("contains", "exports", *DEPENDENCIES)
IMPORT_CODES = ("unresolved-module", "ambiguous-module", "unresolved-export", "ambiguous-export")
USAGE_CODES = ("unresolved-member", "unbound-callee")


@dataclass(frozen=True)
class Graph:
    """Nodes ``(project_id, id, ...)``, edges ``(project_id, edge_key, source_id, target_id, ...)``, the unresolved
    references ``(project_id, ref_key, ...)`` and the call-sites' arguments ``(project_id, id, pos, ...)``."""

    nodes: DataFrame
    edges: DataFrame
    tail: DataFrame
    payload: DataFrame | None = None

    def project(self, project_id: str) -> Graph:
        only = lambda df: None if df is None else df.filter(F.col("project_id") == project_id)
        return Graph(only(self.nodes), only(self.edges), only(self.tail), only(self.payload))

    def dependencies(self, kinds: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def violations(self) -> DataFrame:
        """Rows that break an invariant, with its name; empty for a sound graph."""
        e = self.edges.filter((F.col("resolution") == "inferred") != F.col("confidence").isNotNull()).select("project_id", F.col("edge_key").alias("key"), F.lit("confidence").alias("rule"))
        k = self.edges.filter(~F.col("kind").isin(*EDGE_KINDS)).select("project_id", F.col("edge_key").alias("key"), F.lit("edge-kind").alias("rule"))
        n = self.nodes.filter(~F.col("kind").isin(*NODE_KINDS)).select("project_id", F.col("id").alias("key"), F.lit("node-kind").alias("rule"))
        s = self.nodes.filter(~F.col("sub_kind").rlike("^[a-z0-9-]+:.+$")).select("project_id", F.col("id").alias("key"), F.lit("sub-kind").alias("rule"))
        return e.unionByName(k).unionByName(n).unionByName(s)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting gets a temporary folder; any other master, or none at all, raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "level") -> DataFrame:
    """Write to the shared folder and read back, so that loops keep short plans."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
