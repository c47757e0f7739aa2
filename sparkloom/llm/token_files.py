"""Token-ID output: flat unsigned integer shards with 64-bit document offsets, memory-mapped by readers.

Each shard consists of ``<name>.bin`` (token ids, unsigned little-endian), ``<name>.idx`` (n + 1 unsigned
64-bit offsets into it, counted in ids) and ``<name>.doc`` (n signed 64-bit document ids). Shards hold
consecutive ranges of ascending document ids. The manifest, written by Spark, names the shards that were
committed; a shard's base is the prefix sum of the ids in all shards before it.

Every text is encoded whole, by the tokenizers library, whatever the vocabulary (``word_ends`` prepares texts for those
that cut words); the longest text bounds the memory of a task. Null and empty texts give the end id alone. Rows with a null document id come first; the manifest says how many
a shard has (``n_null``), their places in the ``.doc`` file hold 0, and results have null again. Rows that share an id
are encoded one by one, in the order of a hash of their texts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import chunks, posix, scratch
from sparkloom.llm.word_ends import WholeTexts

MANIFEST = "shard int, file string, n_docs long, n_null long, n_ids long"

_encoders: dict[str, WholeTexts] = {}


def encoder(path: str) -> WholeTexts:
    """One encoder for each vocabulary in a worker; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = WholeTexts(path)
    return _encoders[path]


def id_dtype(vocabulary: str, end_id: int) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if top < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode whole texts in ascending document order; returns the manifest with each shard's ``base``.

    Tasks write under a name of their own attempt, and only the names of successful attempts reach the manifest,
    so lost executors and repeated attempts leave the result whole.
    """
    spark = docs.sparkSession
    place = posix(folder)
    dtype = id_dtype(vocabulary, end_id)
    end = np.asarray([end_id], dtype).tobytes()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary)
        name = f"{place}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        os.makedirs(place, exist_ok=True)
        n_docs = n_ids = n_null = 0
        with open(name + ".bin", "wb") as ids, open(name + ".idx", "wb") as idx, open(name + ".doc", "wb") as doc:
            idx.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                doc_ids, missing, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
                offsets = np.empty(len(texts), "<u8")
                for part in chunks([len(t) for t in texts]):
                    for i, found in enumerate(encode(texts[part]), part.start):
                        ids.write(np.asarray(found, dtype).tobytes() + end)
                        n_ids += len(found) + 1
                        offsets[i] = n_ids
                idx.write(offsets.tobytes())
                doc.write(doc_ids.to_numpy().astype("<i8").tobytes())
                n_docs += len(texts)
                n_null += missing.true_count
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "file": [os.path.basename(name)], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # The hash spreads rows that share an id, and orders them; equal hashes go by the text.
    rows = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), F.col("text").cast("binary"))
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row a shard: the prefix sum runs over a list whose length is the number of output files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """Per document of the memory-mapped shards: ``doc_id, start, n_tokens, ids_crc32``."""
    place = posix(folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if not row.n_docs:
                    continue
                ids = np.memmap(f"{place}/{row.file}.bin", dtype, "r")
                idx = np.memmap(f"{place}/{row.file}.idx", "<u8", "r")
                doc = np.memmap(f"{place}/{row.file}.doc", "<i8", "r")
                if len(idx) != row.n_docs + 1 or len(doc) != row.n_docs or int(idx[-1]) != row.n_ids or len(ids) != row.n_ids:
                    raise ValueError(f"{row.file}: its lengths differ from the manifest")
                for at in range(0, row.n_docs, 5_000):
                    to = min(at + 5_000, row.n_docs)
                    off = np.asarray(idx[at : to + 1], np.int64)
                    part = np.asarray(ids[off[0] : off[-1]]).astype("<u4")
                    crc = [zlib.crc32(part[s:e]) for s, e in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)]
                    yield pd.DataFrame({"doc_id": np.asarray(doc[at:to]), "missing": np.arange(at, to) < row.n_null, "start": off[:-1] + row.base, "n_tokens": np.diff(off), "ids_crc32": np.asarray(crc, np.int64)})

    shards = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    out = shards.mapInPandas(read, "doc_id long, missing boolean, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files below the shared scratch folder, read them back and describe each document."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, vocabulary, end_id)
    return read_token_files(manifest, folder, id_dtype(vocabulary, end_id))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
