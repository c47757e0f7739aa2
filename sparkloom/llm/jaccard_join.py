"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed runs of five words. Texts with equal sets are one class from the start. A set is embedded
as ``COORDINATES`` min-wise hashes: two sets share each with a chance equal to their similarity. A run samples one
coordinate at the root, and sets that share its value go down one path. A bucket of up to ``LIMIT`` sets is searched by
brute force; a larger one is split on two freshly sampled coordinates for each path, up to ``DEPTH`` levels, unless the
split would leave most pairs together anyway. What stays large is searched in blocks, all against all, without a cap.
Runs are repeated until a pair at the threshold is found with probability ``RECALL``.

In a bucket, pairs are first compared by the embedding (a pair at the threshold is lost here with a chance below
one in a million) and by set sizes; only rows with a promising pair go on to the exact comparison of whole sets. A pair
is looked at in the first bucket that it shares, so it counts once, and no pair ever becomes a row: buckets return the
number of links by set, and the links of a spanning forest.

A text of one to four words is one run of its words; a text without words but with other characters is a run of its
own; null and empty texts have no runs, link to nothing and are classes of their own. Repeated rows are copies of each
other. A null id stays null and takes no part in naming classes unless all ids of a class are null. Other columns are
ignored by :func:`jaccard_join` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, mix, pieces, shielded, word_hashes
from sparkloom.llm.components import components

#: Words in a run, similarity, coordinates, bucket size, levels, recall by pair, and embedding's slack.
WORDS, SIMILARITY, COORDINATES, LIMIT, DEPTH, RECALL, SLACK = 5, 0.8, 64, 256, 3, 0.9999, 5.0
#: Ids that are broadcast at most (about 100 MB in memory); beyond, texts are shuffled to them.
BROADCAST_IDS = 2_000_000
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs that find a pair at the threshold, split at every level, with the wanted probability."""
    once = similarity * (1 - (1 - similarity) ** 2) ** (DEPTH - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def run_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of hashed word runs of each text."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total[: n - k] += hashes[k:] * _MULTIPLIERS[k]
    total = mix(total)
    out = []
    for text, s, e in zip(texts, bounds[:-1], bounds[1:], strict=True):
        if e - s >= words:
            out.append(np.unique(total[s : e - words + 1]))
        elif e > s:
            out.append(mix(np.asarray([(hashes[s:e] * _MULTIPLIERS[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)], np.uint64)))
        elif text:
            import xxhash

            out.append(np.asarray([xxhash.xxh3_64_intdigest(text)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> str | None:
    """128 bits that stand for a set."""
    if not len(s):
        return None
    other = mix(s ^ np.uint64(0xA0761D6478BD642F))
    return f"{int(s.sum(dtype=np.uint64)) ^ len(s):016x}{int(other.sum(dtype=np.uint64)):016x}"


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """Min-wise hashes (sets, COORDINATES) of non-empty sets."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.int32)
    for k in range(COORDINATES):
        h = (flat ^ _MULTIPLIERS[-1 - k]) * _MULTIPLIERS[k]
        out[:, k] = (np.minimum.reduceat(h, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, h, key, n, sig`` by row of ``docs(doc_id, h, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"]
            for first, texts in pieces(batch["text"]):
                sets = run_sets(texts, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, embed([sets[i] for i in full]), strict=True):
                        sig[i] = row
                yield pd.DataFrame({"doc_id": ids.iloc[first : first + len(texts)].to_numpy(), "h": batch["h"].iloc[first : first + len(texts)].to_numpy(), "key": [set_key(s) for s in sets], "n": [len(s) for s in sets], "sig": sig}).astype({"doc_id": ids.dtype})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, key string, n long, sig array<int>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``key, members``: the packed sets of ``docs(text)``, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in pieces(batch["text"]):
                sets = [s for s in run_sets(texts, words) if len(s)]
                yield pd.DataFrame({"key": [set_key(s) for s in sets], "members": [s.tobytes() for s in sets]})

    return docs.select("text").mapInPandas(run, "key string, members binary")


def child(path: Column, coordinate: Column, sig: Column) -> Column:
    return F.xxhash64(path, coordinate, F.element_at(sig, coordinate.cast("int") + 1))


def chosen_paths(sets: DataFrame, runs: int) -> DataFrame:
    """``key, path, size``: the buckets of ``sets(key, sig)`` that hold two sets or more.

    Only keys and paths are shuffled; embeddings are fetched again for the buckets that are split.
    """
    at = sets.select("key", F.explode(F.array(*(child(F.lit(r), F.lit(r * 7 % COORDINATES), F.col("sig")) for r in range(runs)))).alias("path"))
    done = []
    for level in range(1, DEPTH + 1):
        size = at.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = cut(at.join(size, "path").select("key", "path", "size"), f"paths-{level}")
        if level == DEPTH:
            done.append(shared)
            break
        done.append(shared.filter(F.col("size") <= LIMIT))
        large = shared.filter(F.col("size") > LIMIT).join(sets.select("key", "sig"), "key")
        picks = [F.pmod(F.xxhash64("path", F.lit(level), F.lit(j)), F.lit(COORDINATES)) for j in range(2)]
        split = large.select("key", "size", F.col("path").alias("parent"), F.explode(F.array(*(child(F.col("path"), c, F.col("sig")) for c in picks))).alias("path"))
        split = cut(split, f"split-{level}")
        # The share of a bucket's pairs that a split would keep together; where most stay, it is searched as it is.
        kept = split.groupBy("parent", "size", "path").agg(F.count(F.lit(1)).alias("c")).groupBy("parent", "size").agg((F.sum(F.col("c") * F.col("c")) / (2 * F.col("size") * F.col("size"))).alias("kept"))
        alike = cut(kept.filter("kept >= 0.4").select("parent"), f"alike-{level}")
        done.append(shared.filter(F.col("size") > LIMIT).join(alike.withColumnRenamed("parent", "path"), "path", "left_semi").select("key", "path", "size"))
        at = split.join(alike, "parent", "left_anti").select("key", "path")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def tiles(rows: DataFrame) -> DataFrame:
    """Deal buckets larger than ``LIMIT`` over blocks so that all pairs of blocks meet: adds ``lo, hi, side``."""
    parts = F.ceil(F.col("size") / LIMIT).cast("int")
    own = F.pmod(F.xxhash64("key", "path"), parts).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "size")


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of rows that come sorted by ``by``."""
    held: list[pd.DataFrame] = []
    at = None
    for batch in batches:
        k = batch[by].to_numpy()
        if not len(k):
            continue
        edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
        for s, e in zip(edge, np.r_[edge[1:], len(k)], strict=True):
            key = tuple(k[s])
            if key != at and held:
                yield at, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            at = key
            held.append(batch.iloc[s:e])
    if held:
        yield at, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def first_shared(part: pd.DataFrame, path: int) -> np.ndarray:
    """For each two rows, whether no smaller path is common to both: here they are looked at."""
    earlier = [[p for p in paths if p < path] for paths in part["paths"]]
    known = {p: i for i, p in enumerate(sorted(set().union(*earlier)))}
    if not known:
        return np.ones((len(part), len(part)), bool)
    m = np.zeros((len(part), len(known)), np.float32)
    for i, paths in enumerate(earlier):
        m[i, [known[p] for p in paths]] = 1
    return (m @ m.T) == 0


def eligible(part: pd.DataFrame, path: int, similarity: float) -> np.ndarray:
    """Pairs i < j of a tile that may reach the similarity by their sizes and belong to this bucket."""
    n, side = part["n"].to_numpy(np.float64), part["side"].to_numpy()
    ok = np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n)
    if side.any():
        ok &= side[:, None] != side[None, :]
    return np.triu(ok & first_shared(part, path), 1)


def promising(part: pd.DataFrame, path: int, similarity: float) -> np.ndarray:
    """Rows with a pair that the embedding doesn't rule out."""
    ok = eligible(part, path, similarity)
    i, j = np.nonzero(ok)
    sig = np.stack(part["sig"].to_list())
    level = similarity * COORDINATES - SLACK * math.sqrt(similarity * (1 - similarity) * COORDINATES)
    out = np.zeros(len(part), bool)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        good = (sig[a] == sig[b]).sum(1) >= level
        out[a[good]] = out[b[good]] = True
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the members that two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, member, count = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[member] > 1
    member, owner = new[member[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    width = 4096
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        s, e = np.searchsorted(member, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[s:e], member[s:e] - at] = 1
        out += m @ m.T
    return out


def linked(part: pd.DataFrame, path: int, similarity: float) -> np.ndarray:
    """Pairs of a tile whose exact similarity reaches the threshold, as a symmetric matrix."""
    shared = overlaps([np.frombuffer(x, np.uint64) for x in part["members"]]).astype(np.float64)
    n = part["n"].to_numpy(np.float64)
    # The shared members reach similarity x (all members) only if this holds; no division, so no rounding of ratios.
    good = shared * (1 + similarity) >= similarity * np.add.outer(n, n) - 1e-9
    good &= eligible(part, path, similarity)
    return good | good.T


def forest(good: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the groups of a symmetric matrix, as stars."""
    out, left = [], np.ones(len(good), bool)
    for root in np.flatnonzero(good.any(1)):
        if not left[root]:
            continue
        group = np.zeros(len(good), bool)
        group[root] = True
        edge = group
        while (edge := good[edge].any(0) & ~group).any():
            group |= edge
        left &= ~group
        out += [(root, k) for k in np.flatnonzero(group) if k != root]
    return out


def with_bound(ids: DataFrame, most: int) -> DataFrame:
    """``ids``, to be broadcast where a count shows that they are few; larger ones are shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids


def link_sets(docs: DataFrame, sets: DataFrame, similarity: float, words: int, runs: int) -> DataFrame:
    """``a, b, w``: w links of set a where b is null, and links of spanning forests elsewhere."""
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["path", "lo", "hi"]
    found = chosen_paths(sets, runs)
    of_set = found.groupBy("key").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.collect_list(F.struct("path", "size")).alias("own"))
    rows = sets.join(of_set, "key").select("key", "doc", "n", "copies", "sig", "paths", F.inline("own"))
    dealt = tiles(rows).repartition(shares, *by).sortWithinPartitions(*by)

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (path, _, _), part in grouped(batches, by):
            if len(part) > 1 and (keep := promising(part, path, similarity)).any():
                yield part.loc[keep, ["key", "doc", "n", "copies", "paths", "path", "lo", "hi", "side"]]

    doc_type = sets.schema["doc"].dataType.simpleString()
    kept = cut(dealt.mapInPandas(sift, f"key string, doc {doc_type}, n long, copies long, paths array<long>, path long, lo int, hi int, side int"), "promising")
    wanted = cut(kept.select(F.col("doc").alias("_w")).distinct(), "wanted")
    needed = docs.join(with_bound(wanted, BROADCAST_IDS), F.col("doc_id") == F.col("_w"), "left_semi")
    if not wanted.filter("_w IS NULL").isEmpty():
        needed = needed.unionByName(docs.filter("doc_id IS NULL"))
    whole = kept.drop("doc").join(sets_of(needed, words).dropDuplicates(["key"]), "key").repartition(shares, *by).sortWithinPartitions(*by)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (path, _, _), part in grouped(batches, by):
            good = linked(part, path, similarity)
            links = good @ part["copies"].to_numpy(np.int64)
            keys, own = part["key"].to_numpy(), np.flatnonzero(links)
            trees = forest(good)
            if len(own):
                yield pd.DataFrame({"a": [*keys[own], *(keys[i] for i, _ in trees)], "b": [*[None] * len(own), *(keys[j] for _, j in trees)], "w": [*links[own], *[0] * len(trees)]})

    return cut(whole.mapInPandas(verify, "a string, b string, w long"), "links")


def find_classes(docs: DataFrame, similarity: float, words: int, recall: float) -> DataFrame:
    """A row per row of ``docs(doc_id, text)`` with the columns of :func:`jaccard_join`, ``h`` (a hash of the text) and
    ``component``: what tells classes apart, null for texts without runs."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rows = cut(signatures(docs, words), "signatures")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    one = rows.filter("key IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "n", "sig")
    sets = cut(classes.join(one, (F.col("key") == F.col("_k")) & F.col("doc").eqNullSafe(F.col("_d"))).drop("_d", "_k").dropDuplicates(["key"]), "sets")
    found = link_sets(docs, sets, similarity, words, runs_needed(similarity, recall))
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("w").alias("links"))
    parts = components(found.filter("b IS NOT NULL"))
    named = parts.join(sets.select("key", "doc"), "key")
    names = named.groupBy("component").agg(F.min("doc").alias("class_doc"))
    linked_sets = named.join(names, "component").select("key", "component", "class_doc").join(links.withColumnRenamed("a", "key"), "key", "left")
    out = rows.select("doc_id", "h", "key").join(classes, "key", "left").join(linked_sets, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_doc", "doc", "doc_id").alias("class_id"),
        F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("doc", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        "h",
        F.coalesce("component", "key").alias("component"),
    )


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """A row per row of ``docs(doc_id, text)``: ``doc_id, class_id, n_links, copy_id, n_copies``.

    ``class_id`` is the smallest id among all documents that links connect, ``n_links`` the number of other documents
    at the similarity or above, ``copy_id`` the smallest id among those with the same set and ``n_copies`` their number.
    Classes whose smallest ids are equal, because different texts share an id, show the same ``class_id``.
    """
    return find_classes(docs, similarity, words, recall).drop("h", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns: that with the smallest id, null last, then the smallest text hash.

    Rows are told apart by id and text, so different texts that share an id are kept or dropped each on its own; of
    rows that repeat both, one stays. Texts without runs (null or empty) are classes of their own and stay, all of them.
    """
    given, names = shielded(docs, ("doc_id", "text"))
    found = find_classes(given, SIMILARITY, WORDS, RECALL)
    alike = found.filter("component IS NOT NULL").groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("first"))
    kept = cut(first.select(F.col("first.doc_id").alias("_kept"), F.col("first.h").alias("_h"), F.col("first.n").alias("_n")), "kept")
    text = F.col("text").cast("string")
    marked = given.withColumn("_hash", F.xxhash64(text)).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_h")), "left")
    once = marked.filter((F.coalesce(text, F.lit("")) == "") | (F.col("_n") == 1)).select(*names)
    again = marked.filter("_n > 1").select(*names, "_hash").dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return once.unionByName(again).toDF(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
