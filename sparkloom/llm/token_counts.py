"""Token counts by field: whole documents are encoded once, and tokens fall to the fields that hold them.

The fields of a row are joined by line ends into one text. Tokens come with a map of their character spans, which is
interval-joined to the fields' spans (a line end belongs to the field before it): each field boundary is looked up in
the map, and a field's tokens are those between its boundaries. A token that crosses a boundary goes
to one field by rule: ``first`` (the field of its first character), ``last`` or ``most`` (the field with most of its
characters, or bytes with a file of ranks; the earlier one on a tie). Counts of a row's fields always add up to the tokens of its text.

Null fields count as empty and still have a row with no tokens of their own but the separator's. Repeated rows are
counted on their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import chunks

RULES = ("first", "last", "most")


class OffsetMap:
    """The tokens of a whole text by the tokenizers library, with its map of character spans."""

    def __init__(self, encoding, length: int):
        self.encoding, self.length = encoding, length

    def __len__(self) -> int:
        return len(self.encoding)

    def boundary(self, at: int) -> tuple[int, tuple[int, int] | None]:
        """How many tokens end at or before ``at``, and the span of the one that crosses it, if any does.

        Characters that no token holds are stepped over.
        """
        token = next((t for k in range(at, self.length) if (t := self.encoding.char_to_token(k)) is not None), None)
        if token is None:
            return len(self), None
        span = self.encoding.token_to_chars(token)
        return token, span if span[0] < at else None


class ByteMap:
    """The tokens of a whole text by a rank file, whose byte lengths add up to byte spans."""

    def __init__(self, ends: np.ndarray):
        self.ends = ends

    def __len__(self) -> int:
        return len(self.ends)

    def boundary(self, at: int) -> tuple[int, tuple[int, int] | None]:
        token = int(np.searchsorted(self.ends, at, "right"))
        start = int(self.ends[token - 1]) if token else 0
        return token, (start, int(self.ends[token])) if token < len(self.ends) and start < at else None


class TokenizersEncoder:
    """A vocabulary of the tokenizers library. Places are counted in characters."""

    size = staticmethod(len)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __call__(self, texts: list[str]) -> list[OffsetMap]:
        return [OffsetMap(e, len(t)) for e, t in zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), texts, strict=True)]


class RankEncoder:
    """A vocabulary of the tiktoken library: a file of ranks and a pattern. Places are counted in UTF-8 bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]

    def size(self, text: str) -> int:
        return len(text) if text.isascii() else len(text.encode())

    def __call__(self, texts: list[str]) -> list[ByteMap]:
        return [ByteMap(np.cumsum(self.lengths[np.asarray(self.encode(t), np.int64)])) for t in texts]


_encoders: dict = {}


def encoder(vocabulary: str, pattern: str | None):
    """One encoder for each vocabulary in a worker; it outlives the task."""
    key = vocabulary, pattern
    if key not in _encoders:
        _encoders[key] = TokenizersEncoder(vocabulary) if pattern is None else RankEncoder(vocabulary, pattern)
    return _encoders[key]


def choose(span: tuple[int, int], starts: list[int], rule: str) -> int:
    """The section that gets a token which crosses a boundary. ``starts``: ascending section starts, from 0."""
    first, last = bisect_right(starts, span[0]) - 1, bisect_right(starts, span[1] - 1) - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    ends = [*starts[1:], span[1]]
    return max(range(first, last + 1), key=lambda k: (min(ends[k], span[1]) - max(starts[k], span[0]), -k))


def attribute(tokens: OffsetMap | ByteMap, starts: list[int], rule: str) -> tuple[list[int], list[int]]:
    """Tokens of each section, and how many of these cross a boundary.

    What lies between two neighbouring boundaries is the difference of their token indexes; only crossing tokens are
    looked at one by one. Of tokens that share a character (bytes of one letter) all belong to its section.
    """
    counts, crossed = [0] * len(starts), [0] * len(starts)
    begin, seen = 0, -1
    for k in range(len(starts)):
        token, span = (len(tokens), None) if k + 1 == len(starts) else tokens.boundary(starts[k + 1])
        counts[k] += max(0, token - begin)
        begin = token + (span is not None)
        if span is not None and token != seen:
            seen = token
            to = choose(span, starts, rule)
            counts[to] += 1
            crossed[to] += 1
    return counts, crossed


def count_tokens(docs: DataFrame, fields: list[str], vocabulary: str, id_col: str = "doc_id", rule: str = "first", pattern: str | None = None) -> DataFrame:
    """A row per document and field: ``doc_id, field, n_chars, n_tokens, n_crossing`` (crossing tokens given to it).

    ``vocabulary`` is a file of the tokenizers library or, with the ``pattern`` that splits text, a file of ranks.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    names = [f"_f{i}" for i in range(len(fields))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary, pattern)
        k = len(fields)
        for batch in batches:
            lengths = np.asarray([batch[n].str.len().to_numpy(np.int64) for n in names]).T
            for part in chunks((lengths.sum(axis=1) + k).tolist()):
                rows = list(zip(*(batch[n].iloc[part] for n in names), strict=True))
                texts = ["\n".join(row) for row in rows]
                starts = [list(accumulate((encode.size(x) + 1 for x in row[:-1]), initial=0)) for row in rows]
                got = [attribute(tokens, s, rule) for tokens, s in zip(encode(texts), starts, strict=True)]
                counts, crossed = np.asarray([g[0] for g in got]).ravel(), np.asarray([g[1] for g in got]).ravel()
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].repeat(k).to_numpy(), "field": fields * len(texts), "n_chars": lengths[part].ravel(), "n_tokens": counts, "n_crossing": crossed})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, names, strict=True)))
    out = rows.mapInPandas(run, "doc_id string, field string, n_chars long, n_tokens long, n_crossing long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, ["source", "lang", "text"], public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
