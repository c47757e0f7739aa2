"""Benchmark decontamination with suffix arrays over the training words.

Consecutive whole documents make up a shard of about ``SHARD`` bytes. All suffixes of its words are sorted into a suffix
array, by as many words as a window has, and every suffix of the benchmark that begins a window is looked up in it by
binary search; equal windows are looked up once, with the list of items that hold them. Words are 64-bit hashes, and
sums of their products with powers tell how many words two suffixes share. Each place that is found is then looked up
among the benchmark's own suffixes, which gives the longest verbatim match there, however long.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
empty texts have no words and are never hit. Null item ids take part under an empty name. Repeated items and
documents are treated alike, each on its own. Other columns are kept untouched by :func:`decontaminate`, and by
:func:`find_contamination` unless they have a name of ``MARKS``, which is replaced. Empty tables give no rows, or no hits.

The benchmark is fetched and broadcast in parts of about ``part_bytes``, whatever its size: a larger one takes several
passes over the documents, each written before the next, and each adds what its items hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, pieces, shielded, word_hashes

SHARD = 4 << 20
_HIT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MATCH = pa.struct([("doc_word", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.string()), ("item_word", pa.int32())])
#: ``_hits``: runs of hit words. ``_matches``: longest matches that none to their left goes on into, with an item.
MARKS = {
    "_n_words": ("long", pa.int64()),
    "_n_hit": ("long", pa.int64()),
    "_items": ("array<string>", pa.list_(pa.string())),
    "_hits": ("array<struct<start:int,end:int>>", pa.list_(_HIT)),
    "_matches": ("array<struct<doc_word:int,n_words:int,item_id:string,item_word:int>>", pa.list_(_MATCH)),
}
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """A sequence of word hashes, with sums that tell whether two stretches are alike."""

    powers = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        self.words = words
        Words.grow(len(words))
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * Words.powers[: len(words)], dtype=np.uint64)]

    @staticmethod
    def grow(n: int) -> None:
        if len(Words.powers) <= n:
            Words.powers = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(2 * n, _BASE)], dtype=np.uint64)

    def shared(self, at: np.ndarray, other: Words, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words, ``limit`` at most, the suffixes from ``at`` and those of ``other`` from ``place`` share."""
        Words.grow(max(len(self.words), len(other.words)))
        limit = np.minimum(limit, np.minimum(len(self.words) - at, len(other.words) - place))
        out = np.zeros(len(at), np.int64)
        step = 1 << int(limit.max(initial=1)).bit_length()
        while step := step >> 1:
            k = np.flatnonzero(out + step <= limit)
            a, b = at[k] + out[k], place[k] + out[k]
            alike = (self.sums[a + step] - self.sums[a]) * Words.powers[b] == (other.sums[b + step] - other.sums[b]) * Words.powers[a]
            out[k[alike]] += step
        return out


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of their suffixes' first ``depth`` words, by doubling of ranks."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth and (top := int(rank.max(initial=0)) + 1) < len(rank):
        step = min(known, depth - known)
        rank = np.unique(rank * top + np.r_[rank[step:], np.zeros(min(step, len(rank)), np.int64)], return_inverse=True)[1]
        known += step
    return np.argsort(rank, kind="stable")


def search(text: Words, order: np.ndarray, query: Words, place: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all queries at once: how many suffixes of ``text`` come before each, or before what follows it."""
    first = text.words[order]
    lo = np.searchsorted(first, query.words[place], "left")
    hi = np.searchsorted(first, query.words[place], "right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        at, own, most = order[mid], place[open_], length[open_]
        n = text.shared(at, query, own, most)
        end = n == most
        a, b = at + n, own + n
        less = np.where(a < len(text.words), text.words[np.minimum(a, len(text.words) - 1)], 0) < query.words[np.minimum(b, len(query.words) - 1)]
        go = np.where(end, after, less)
        lo[open_] = np.where(go, mid + 1, lo[open_])
        hi[open_] = np.where(go, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


@dataclass
class Part:
    """A part of the benchmark: its words, their suffix array, and its distinct windows with the items that hold them."""

    names: list[str]
    text: Words
    begins: np.ndarray  # where each item begins; a separator follows each
    order: np.ndarray
    place: np.ndarray  # one place of each window
    length: np.ndarray
    first: np.ndarray  # where each window's list begins in ``items``, and the end of the last
    items: np.ndarray


def make_part(items: list[tuple[str, str]], window: int) -> Part | None:
    items = sorted(items)
    hashes, bounds = word_hashes([text.encode("utf-8", "surrogatepass") for _, text in items])
    keep = np.flatnonzero(np.diff(bounds))
    if not len(keep):
        return None
    count = np.diff(bounds)[keep]
    begins = np.cumsum(np.r_[0, count[:-1] + 1])
    words = np.ones(int(count.sum()) + len(keep), np.uint64)
    owner = np.repeat(np.arange(len(keep)), count)
    words[np.arange(len(owner)) + owner] = np.maximum(hashes, 2)
    text = Words(words)
    spot = np.arange(len(owner)) + owner
    need = np.minimum(count, window)[owner]
    starts = spot - begins[owner] <= (count[owner] - need)
    spot, need, owner = spot[starts], need[starts], owner[starts]
    key = (text.sums[spot + need] - text.sums[spot]) * Words.powers[len(words) - spot]
    _, window_of = np.unique(np.stack([key, need.astype(np.uint64)], 1), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([window_of.ravel(), owner], 1), axis=0)
    one = np.zeros(int(window_of.max()) + 1, np.int64)
    one[window_of.ravel()] = np.arange(len(spot))
    return Part([items[k][0] for k in keep], text, begins, suffix_array(words, int(count.max())), spot[one], need[one], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), pairs[:, 1])


def occurrences(text: Words, part: Part, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All (place in the shard, window) at which a benchmark window occurs."""
    order = suffix_array(text.words, depth)
    lo, hi = (search(text, order, part.text, part.place, part.length, after) for after in (False, True))
    count = hi - lo
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(lo, count) + inner], np.repeat(np.arange(len(count)), count)


def longest(text: Words, at: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """The longest match at each place: its words, and a place in the benchmark."""
    full = np.full(len(at), len(part.text.words))
    slot = search(part.text, part.order, text, at, full, False)
    best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for near in (slot, slot - 1):
        place = part.order[np.clip(near, 0, len(part.order) - 1)]
        n = text.shared(at, part.text, place, full)
        where = np.where(n > best, place, where)
        best = np.maximum(best, n)
    return best, where


def join_runs(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def marks(texts: list[str | None], part: Part | None, window: int, before: dict[str, list] | None = None) -> dict[str, list]:
    """The columns of ``MARKS`` for a batch of whole documents, with what earlier parts have found."""
    n = len(texts)
    out = {"_n_words": [0] * n, "_n_hit": [0] * n, "_items": [[] for _ in range(n)], "_hits": [[] for _ in range(n)], "_matches": [[] for _ in range(n)]} if before is None else before
    for base, shard in pieces(texts, SHARD):
        hashes, bounds = word_hashes(shard)
        count = np.diff(bounds)
        out["_n_words"][base : base + len(shard)] = count.tolist()
        if part is None or not len(hashes):
            continue
        begins = bounds[:-1] + np.arange(len(shard))  # a zero after each document
        words = np.zeros(len(hashes) + len(shard), np.uint64)
        words[np.arange(len(hashes)) + np.repeat(np.arange(len(shard)), count)] = np.maximum(hashes, 2)
        text = Words(words)
        at, which = occurrences(text, part, window)
        if not len(at):
            continue
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + part.length[which], -1)
        edge = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False))
        runs = defaultdict(list)
        for d, s, e in zip(np.searchsorted(begins, edge[::2], "right") - 1, edge[::2], edge[1::2], strict=True):
            runs[d].append((int(s - begins[d]), int(e - begins[d])))
        for d, own in runs.items():
            out["_hits"][base + d] = hits = join_runs([*own, *((h["start"], h["end"]) for h in out["_hits"][base + d])])
            out["_n_hit"][base + d] = sum(h["end"] - h["start"] for h in hits)
        doc = np.searchsorted(begins, at, "right") - 1
        pairs = np.unique(np.stack([doc, which], 1), axis=0)
        for d in np.unique(doc):
            own = pairs[np.searchsorted(pairs[:, 0], d) : np.searchsorted(pairs[:, 0], d, "right"), 1]
            found = np.unique(np.concatenate([part.items[part.first[w] : part.first[w + 1]] for w in own]))
            out["_items"][base + d] = sorted({part.names[i] for i in found} | set(out["_items"][base + d]))
        place = np.unique(at)
        size, where = longest(text, place, part)
        fresh = np.r_[True, (np.diff(place) != 1) | (size[1:] >= size[:-1])]
        item = np.searchsorted(part.begins, where, "right") - 1
        for p, k, i, w, d in zip(place[fresh], size[fresh], item[fresh], where[fresh], np.searchsorted(begins, place[fresh], "right") - 1, strict=True):
            out["_matches"][base + d].append({"doc_word": int(p - begins[d]), "n_words": int(k), "item_id": part.names[i], "item_word": int(w - part.begins[i])})
    return out


def parts_of(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (item, text) in parts that hold about ``part_bytes`` each."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // part_bytes)
    for k in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()]


def add_marks(docs: DataFrame, part: Part | None, window: int, text_col: str, again: bool) -> DataFrame:
    """One pass: ``docs`` with ``MARKS``; ``again``: they are there and get more."""
    keep = [c for c in docs.columns if c not in MARKS]
    name = lambda c: "`" + c.replace("`", "``") + "`"
    given = docs.select(*(F.col(name(c)) for c in keep), F.col(name(text_col)).cast("string").alias("_given"), *(MARKS if again else ()))
    schema = "".join(f"{name(c)} {docs.schema[c].dataType.simpleString()}, " for c in keep) + ", ".join(f"{k} {d}" for k, (d, _) in MARKS.items())
    given = given.toDF(*(f"c{i}" for i in range(len(given.columns))))
    sent = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = {k: batch.column(len(keep) + 1 + i).to_pylist() for i, k in enumerate(MARKS)} if again else None
            made = marks(batch.column(len(keep)).to_pylist(), sent.value, window, before)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[k], t) for k, (_, t) in MARKS.items())], [*keep, *MARKS])

    return given.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit`` (words inside an occurrence), ``_items``, ``_hits`` and ``_matches``."""
    out = None
    for items in parts_of(benchmark, part_bytes):
        out = add_marks(docs, make_part(items, window), window, text_col, False) if out is None else add_marks(cut(out, "marks"), make_part(items, window), window, text_col, True)
    return add_marks(docs, None, window, text_col, False) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns, whatever these are called."""
    given, names = shielded(docs, ["text"])
    return find_contamination(given, benchmark, window).filter(F.col("_n_hit") == 0).select(*names).toDF(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    most = F.coalesce(F.array_max(F.transform("_matches", lambda m: m["n_words"])), F.lit(0)).cast("long")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"), most.alias("longest_match"))


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple[int, int, int, str, int]]:
    """The same figures, and the longest match, from lists of words, for tests."""
    import re

    from sparkloom.llm.common import WORD

    words = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins, whole = [], [words(text) for _, text in items]
    for (name, _), w in zip(items, whole, strict=True):
        n = min(window, len(w))
        wins += [(name, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for text in texts:
        w, hit, names, starts = words(text), set(), set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(name)
                    starts.add(i)
        most = 0
        for p in starts:
            for item in whole:
                for j in range(len(item)):
                    most = max(most, next((k for k, (x, y) in enumerate(zip(w[p:], item[j:])) if x != y), min(len(w) - p, len(item) - j)))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), most))
    return out
