"""Toxicity by a classifier chain: categories are predicted in order, each model seeing the earlier probabilities.

Features are the distinct words of a text, their first letters (inflected forms share a stem), and how shouted,
symbol-laden and repetitive it is, each in tenths. The features that tell a category's classes apart best by
chi-squared enter linear models. A later model is trained with out-of-fold probabilities of the earlier ones, so
that what it sees in training looks like what it gets in use.

Training takes at most ``SAMPLE`` labelled documents a category, those with the smallest hashes of their ids. All
documents are scored, whole. Null and empty texts have no words and get the models' intercepts. Labels that are null don't
count, other labels of the document do; of
several labels of a document the largest holds. A category without two classes in the labels gets the share of its
positive labels (0 without labels) as its probability everywhere. Repeated rows score alike. Other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, add_columns, cut

#: The documented bound of the training sample and the other parameters.
SAMPLE, FEATURES, LEAST, FOLDS, STEMS, THRESHOLD, PENALTY = 12_000, 600, 4, 3, (4, 5, 6), 0.5, 3e-4
_WORD = re.compile(WORD)


def features_of(text: str | None) -> set[str]:
    """Words, ``^`` and their first 4 to 6 letters, and ``#`` shape features."""
    text = text if isinstance(text, str) else ""
    words = _WORD.findall(text.lower())
    found = set(words)
    tenth = lambda a, b: min(9, int(10 * a / b)) if b else 0
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    shape = {f"#repeats{tenth(len(words) - len(found), len(words))}", f"#symbols{tenth(len(text) - sum(map(len, words)) - text.count(' '), len(text))}", f"#upper{tenth(upper, len(text))}"}
    for n in STEMS:
        found |= {"^" + w[:n] for w in found if len(w) >= n and w[0] != "^"}
    return found | shape


@dataclass
class Chain:
    """Linear models in order. ``weights`` has a category's feature weights, ``earlier`` those of earlier log-odds."""

    categories: list[str]
    weights: list[dict[str, float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def score(self, found: set[str]) -> list[float]:
        odds = []
        for w, e, b in zip(self.weights, self.earlier, self.intercepts, strict=True):
            odds.append(b + sum(w[k] for k in sorted(w.keys() & found)) + sum(x * squash(o) for x, o in zip(e, odds, strict=True)))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, o)))) for o in odds]


def squash(odds: float) -> float:
    """Log-odds held to [-4, 4]: a sure earlier model must not drown the words."""
    return max(-4.0, min(4.0, odds))


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """``doc_id, found`` and a 0/1 column per category, of a bounded sample of labelled documents.

    An id counts once, by its text with the smallest hash, so that rows are as bounded as ids.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories)).dropna("all", subset=categories)
    known = cut(known, "labels")
    order = F.xxhash64("doc_id", F.lit(11)), "doc_id"
    drawn = [known.filter(F.col(c).isNotNull()).orderBy(*order).limit(SAMPLE).select("doc_id") for c in categories]
    # At most SAMPLE ids a category: their size is bounded, whatever the corpus.
    known = known.join(F.broadcast(reduce(DataFrame.union, drawn).distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = {c: batch[c].astype("Int32") for c in categories}
            yield batch.assign(found=[sorted(features_of(t)) for t in batch["text"]], **whole).drop(columns="text")

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", *categories).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {', '.join(f'{c} int' for c in categories)}"
    return cut(rows.select("doc_id", "text", *categories).mapInPandas(run, schema.replace(" text string,", "") + ", found array<string>"), "toxicity-sample")


def choose_features(rows: DataFrame, category: str, n: int, positive: int) -> list[str]:
    """The features that tell the classes apart best by chi-squared, of those in ``LEAST`` documents or more."""
    a, b = F.col("pos"), F.col("all") - F.col("pos")
    c, d = positive - a, (n - positive) - b
    score = n * F.pow(a * d - b * c, 2) / (F.lit(float(positive)) * (n - positive) * (a + b) * F.greatest(n - a - b, F.lit(1)))
    count = rows.select(F.explode("found").alias("f"), F.col(category).alias("y")).groupBy("f").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("all")).filter(F.col("all") >= LEAST)
    return [r.f for r in count.withColumn("score", score).orderBy(F.desc("score"), "f").limit(FEATURES).collect()]


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with a squared penalty, by limited-memory BFGS."""
    n, w = len(y), np.zeros(x.shape[1] + 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]
        r = 1 / (1 + np.exp(-z)) - y
        value = np.logaddexp(0, z).sum() - z @ y
        return value / n + penalty / 2 * (w[:-1] @ w[:-1]), np.r_[r.astype(x.dtype) @ x / n + penalty * w[:-1], r.sum() / n]

    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, t in reversed(past):
            alphas.append(s @ d / (s @ t))
            d -= alphas[-1] * t
        if past:
            d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, t), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - t @ d / (s @ t))
        step = 1.0
        while True:
            new_f, new_g = loss(w - step * d)
            if new_f <= f - 1e-4 * step * (g @ d) or step < 1e-3:
                break
            step /= 2
        s, t = -step * d, new_g - g
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        w, f, g = w + s, new_f, new_g
        if np.abs(g).max() < 1e-5:
            break
    return w


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """Spark draws the sample and picks features over it; the models are fitted on the driver, which gets no more than
    the chosen features of ``SAMPLE`` documents a category."""
    rows = training_rows(docs, labels, categories)
    n, *found = rows.agg(F.count(F.lit(1)), *(F.sum(c) for c in categories), *(F.count(c) for c in categories)).first()
    sums, given = found[: len(categories)], found[len(categories) :]
    two = [0 < (s or 0) < m for s, m in zip(sums, given, strict=True)]
    words = sorted(set().union(*(choose_features(rows.filter(F.col(c).isNotNull()), c, m, s) for c, s, m, ok in zip(categories, sums, given, two, strict=True) if ok)))
    place = {w: k for k, w in enumerate(words)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [np.asarray([place[w] for w in f if w in place], np.int32).tobytes() for f in batch["found"]]
            yield batch.drop(columns="found").assign(f=packed, **{c: batch[c].astype("Int32") for c in categories})

    kept = rows.select(F.xxhash64("doc_id").alias("h"), "found", *categories)
    data = kept.mapInPandas(pack, f"h long, {', '.join(f'{c} int' for c in categories)}, f binary").orderBy("h").toPandas()
    x = np.zeros((n, len(words) + len(categories)), np.float32)  # room for the earlier categories' log-odds
    for i, f in enumerate(data["f"]):
        x[i, np.frombuffer(f, np.int32)] = 1
    fold = np.arange(n) % FOLDS
    chain = Chain(categories)
    for k, c in enumerate(categories):
        y = data[c].astype("float64").to_numpy()
        has = ~np.isnan(y)
        if two[k]:
            mine = slice(None) if has.all() else has  # no copy where every row has the label
            w = fit_linear(x[mine, : len(words) + k], y[mine])
            held = np.zeros(n)
            for f in range(FOLDS if k + 1 < len(categories) else 0):  # out-of-fold log-odds for the models that follow
                train = (fold != f) & has
                part = fit_linear(x[train, : len(words) + k], y[train])
                held[fold == f] = x[fold == f, : len(words) + k] @ part[:-1] + part[-1]
        else:
            share = (sums[k] or 0) / given[k] if given[k] else 0.0
            w = np.r_[np.zeros(len(words) + k), math.log(max(share, 1e-12) / max(1 - share, 1e-12))]
            held = np.full(n, w[-1])
        chain.weights.append({word: float(v) for word, v in zip(words, w, strict=False) if v})
        chain.earlier.append([float(v) for v in w[len(words) : -1]])
        chain.intercepts.append(float(w[-1]))
        x[:, len(words) + k] = np.clip(held, -4, 4)
    return chain


def score_documents(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_p_<category>`` for each category of the chain."""

    def compute(texts: list[str | None]) -> dict[str, list]:
        p = [chain.score(features_of(t)) for t in texts]
        return {f"_p_{c}": [x[k] for x in p] for k, c in enumerate(chain.categories)}

    return add_columns(docs, text_col, {f"_p_{c}": ("double", pa.float64()) for c in chain.categories}, compute)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The table ``labels`` as categories of the chain: low quality comes first, toxicity sees it."""
    return labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), F.col("toxic"))


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_p_low_quality`` and ``_p_toxic`` by a chain fitted on the labelled rows of ``training``."""
    return score_documents(docs, fit_chain(training, chain_labels(labels), ["low_quality", "toxic"]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.round("_p_low_quality", 6).alias("p_low_quality"), F.round("_p_toxic", 6).alias("p_toxic"), (F.col("_p_toxic") >= THRESHOLD).alias("toxic"))
