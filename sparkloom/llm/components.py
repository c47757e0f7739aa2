"""Connected components of links between string keys, by alternating stars.

Every round links each key's neighbours to the smallest of them, first the larger, then the smaller ones. Links become
stars around the smallest key of their component in a number of rounds that grows with the logarithm of its diameter.
Minima are pre-aggregated, and rows meet their key's minimum by key and one of ``SALTS`` numbers, so that the many links
of one key are spread over tasks. Rounds are written to shared storage. Null keys and links of a key to itself are left out; keys without links don't appear in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut


SALTS = 32


def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows(a, b)`` with ``m`` of ``least(a, m)``."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each key's larger neighbours are linked to the smallest of its neighbours and itself."""
    out = both_ways(edges)
    least = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return with_least(out, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def small_star(edges: DataFrame) -> DataFrame:
    """Each key and its smaller neighbours are linked to the smallest of these. Links run from larger to smaller."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``key, component``: the smallest key that each key of ``edges(a, b)`` is linked to, itself included."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct()
    before = None
    for _ in range(rounds):
        edges = cut(small_star(large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("key"), "component")).distinct()
