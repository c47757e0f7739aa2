"""Helpers shared by the corpus operators: scratch storage, lineage cuts and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Everything but ASCII letters and digits separates words; all code points from U+0080 up belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where a local session lacks that setting, a temporary folder takes its place and is set. With any other master, or
    none at all, no folder of one machine would do, so its absence raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def posix(uri: str) -> str:
    """The mounted path of a shared folder, for files that are memory-mapped or appended byte by byte."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: binary files need a shared folder that is mounted on every machine (file://)")
    return parts.path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back, so that no later job recomputes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(df: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns but ``needed`` renamed, so that none clashes with an operator's own; and the new names.

    ``select(*names).toDF(*df.columns)`` gives them their names back.
    """
    names = [c if c in needed else f"x{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), names


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, each row's place from 0 in its ``group`` by ``order``, and ``total``, the group's rows.

    One range exchange sorts everything, so a group of any size is spread; rows that are equal in ``order`` go by their
    place in ``df``, which should be a table that was read or written, so that a repeated task finds the same places.
    Only one row for each group and partition is summed up afterwards.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group, *order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(placed.drop("_tie").withColumn("_spot", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_spot", 33))
    runs = placed.groupBy(group, "_part").agg(F.min("_spot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    return placed.join(runs, [group, "_part"]).withColumn("pos", F.col("_spot") + F.col("_shift")).drop("_spot", "_part", "_shift")


def crc32_sql(table: str, text: str, key: str) -> str:
    """Two common table expressions for DuckDB; the second, ``crcs``, has ``key`` and ``crc``, the text's CRC-32."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: {step}, b)) AS t),
    crcs AS (SELECT {key}, xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS crc FROM (SELECT DISTINCT {key}, {text} FROM {table}), crc_table)"""


def chunks(sizes: list[int], most: int = 1 << 17) -> Iterator[slice]:
    """Consecutive texts that come to ``most`` characters; a longer text is a chunk of its own."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield slice(first, i)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def add_columns(df: DataFrame, text_col: str, ddl: dict[str, tuple[str, pa.DataType]], compute: Callable[[list[str | None]], dict[str, list]]) -> DataFrame:
    """``df`` with columns that ``compute`` makes of a batch of texts; all other columns pass through untouched.

    Columns of ``df`` that have one of the new names are replaced, as ``withColumn`` does.
    """
    keep = [c for c in df.columns if c not in ddl]
    given = df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in keep), F.col(text_col).cast("string")).toDF(*(f"c{i}" for i in range(len(keep) + 1)))
    fields = "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[k], t) for k, (_, t) in ddl.items())], [*keep, *ddl])

    return given.mapInArrow(run, fields + ", ".join(f"{k} {d}" for k, (d, _) in ddl.items()))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser over unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = np.zeros(256, np.uint64)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _BYTE[_b] = _b
    if 0x41 <= _b <= 0x5A:
        _BYTE[_b] = _b + 32
_IS_WORD = _BYTE > 0
_STEP, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def weights(n: int) -> np.ndarray:
    """A number for each of ``n`` places of a word, none of which follows from another by a factor.

    Powers of one base would give words of a thousand letters, a sequence and its complement, the same sum.
    """
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) ^ _KEY)


_WEIGHTS = weights(256)
PIECE = 1 << 20


def pieces(texts: Iterable[str | None], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive whole texts as UTF-8, about ``most`` bytes at a time, with the position of the first."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` (A-Z lower-cased), and where each text begins (and the last ends)."""
    global _WEIGHTS
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lens = ends - starts
    first = np.cumsum(lens) - lens
    if lens.max() > len(_WEIGHTS):
        _WEIGHTS = weights(int(lens.max()))
    letters = _BYTE[buf[inside]]
    place = np.arange(len(letters)) - np.repeat(first, lens)
    return mix(np.add.reduceat(letters * _WEIGHTS[place], first) + lens.astype(np.uint64)), bounds
