"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells by source, language and topic. A cell's weight starts as its tokens. Each of ``sweeps``
sweeps scales the weights to the goal of every source, then of every language, then of every topic; a block of
``SWEEPS_A_WRITE`` sweeps whose last one changes no weight by more than ``TOLERANCE`` ends them. The cell's share of the
token budget, over its tokens, is the probability with which each of its documents is kept. A document's draw depends on
its id and text alone, so repeated attempts decide alike.

A probability is at most 1. Cells that would need more are fixed at 1, what they give is taken off the budget and the
goals of their values, and the others are raked again, until no cell is added. So the budget is spent wherever the
tokens suffice, and the shares are met as nearly as the fixed cells allow. Where the goals of all cells that are left
are used up, what remains of the budget is spread evenly over those whose targets aren't zero.

A step aggregates the cells by one dimension. Up to ``TASK_CELLS`` cells, counted, go through a block of sweeps in one
task; with more, each step is a join with sums by value, pre-aggregated, and is written. So neither cells nor values
have to fit into a task or the driver, and Spark broadcasts the sums only below its own threshold.

Null and empty values of a dimension are categories of their own ("" stands for both); null texts have no tokens and
are dealt with like any other document of their cell. Cells without tokens keep all their documents, and so do all
cells where no targets hold for any tokens. Repeated rows share their draw. All columns are kept, but for those named
``_topic``, ``_p`` and ``_keep``, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, cut, shielded

#: The parameters of the query.
SWEEPS, EXPONENT, FRACTION, TOLERANCE = 12, 0.5, 0.6, 1e-12
DIMENSIONS = ("source", "lang", "topic")
#: Cells that one task takes at most, and the sweeps between two writes of them.
TASK_CELLS, SWEEPS_A_WRITE = 20_000, 12


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("double")


def topic_of(text: Column) -> Column:
    """A topic by form where documents carry none: tables, shouted or noisy text, notes and prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!! ")), "shout").when(F.contains(text, F.lit("### ")) | F.contains(text, F.lit("%%% ")), "noise").when(F.length(text) < 400, "note").otherwise("prose")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id and the text."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(16**12)


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens by cell of documents with the columns of ``DIMENSIONS`` and ``tokens``."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def with_column(cells: DataFrame, d: str, values: DataFrame, name: str) -> DataFrame:
    """``cells`` with a column of ``values(_v, <name>)`` for their value of a dimension; 0 where it has none."""
    return cells.join(values, F.col(d) == F.col("_v"), "left").drop("_v").fillna(0.0, [name])


def tempered(cells: DataFrame, exponent: float) -> DataFrame:
    """Add ``target_<dimension>``: each value's share, in proportion to its tokens to a power."""
    for d in DIMENSIONS:
        parts = cells.groupBy(F.col(d).alias("_v")).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("part"))
        total = parts.agg(F.sum("part")).first()[0] or 1.0
        cells = with_column(cells, d, parts.select("_v", (F.col("part") / F.lit(total)).alias(f"target_{d}")), f"target_{d}")
    return cells


def with_targets(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the shares of a table ``(dimension, value, share)``; values that it doesn't name get none."""
    for d in DIMENSIONS:
        own = targets.filter(F.col("dimension") == d).groupBy(F.coalesce("value", F.lit("")).alias("_v")).agg(F.sum("share").alias(f"target_{d}"))
        cells = with_column(cells, d, own, f"target_{d}")
    return cells


def with_sum(cells: DataFrame, d: str, value: Column, name: str, few: bool) -> DataFrame:
    """Add the sum of a column over the cells with the same value of a dimension; ``few`` cells lie in one task."""
    if few:
        return cells.withColumn(name, F.sum(value).over(Window.partitionBy(d)))
    return with_column(cells, d, cells.groupBy(F.col(d).alias("_v")).agg(F.sum(value).alias(name)), name)


def rake(cells: DataFrame, sweeps: int, tolerance: float = TOLERANCE, start: str = "tokens", goals: str = "target", few: bool = False) -> DataFrame:
    """``cells`` with ``weight``: the column ``start`` scaled to ``<goals>_<dimension>`` of each dimension in turn."""
    at = cells.withColumn("weight", F.col(start).cast("double"))
    at = at if few else cut(at, "cells")
    while sweeps > 0:
        n = min(SWEEPS_A_WRITE, sweeps)
        at = at.coalesce(1) if few else at
        for i in range(n):
            at = at.withColumn("_before", F.col("weight")) if i == n - 1 else at
            for d in DIMENSIONS:
                now, total = (at, F.sum("weight").over(Window.partitionBy(d))) if few else (with_sum(at, d, F.col("weight"), "_total", few), F.col("_total"))
                weight = F.coalesce(F.try_divide(F.col("weight") * F.col(f"{goals}_{d}"), total), F.lit(0.0))
                at = now.withColumn("weight", weight)
                at = at if few else cut(at.drop("_total"), "step")
        at = cut(at, "sweeps") if few else at
        sweeps -= n
        if sweeps and at.filter(F.abs(F.col("weight") - F.col("_before")) > tolerance * F.col("weight")).isEmpty():
            break
    return at.drop("_before")


def calibrate(cells: DataFrame, fraction: float, sweeps: int) -> DataFrame:
    """``cells`` with ``p``: the probability that a document of the cell is kept."""
    cells = cut(cells, "targets")
    aimed = reduce(and_, (F.col(f"target_{d}") > 0 for d in DIMENSIONS))
    n, total, some = (float(x or 0.0) for x in cells.agg(F.count(F.lit(1)), F.sum("tokens"), F.sum(F.when(aimed, F.col("tokens")))).first())
    if not some:
        return cells.withColumn("p", F.lit(1.0))
    few, budget, given, fixed = n <= TASK_CELLS, fraction * total, cells.columns, F.col("fixed")
    cells, held = cells.withColumn("fixed", F.lit(False)), F.when(fixed, F.col("tokens")).otherwise(0.0)
    while True:
        at = cells.coalesce(1) if few else cells
        for d in DIMENSIONS:
            at = with_sum(at, d, held, "_held", few).withColumn(f"goal_{d}", F.greatest(F.lit(0.0), F.lit(budget) * F.col(f"target_{d}") - F.col("_held"))).drop("_held")
        at = rake(at.withColumn("free", F.col("tokens") - held), sweeps, start="free", goals="goal", few=few)
        rate = F.when(F.col("free") > 0, F.col("weight") / F.col("tokens"))
        spent, weight, most, left = (float(x or 0.0) for x in at.agg(F.sum(held), F.sum("weight"), F.max(rate), F.sum(F.when(aimed, F.col("free")))).first())
        scale = (budget - spent) / weight if weight else 0.0
        if most * scale <= 1:
            spread = F.when(aimed, F.lit((budget - spent) / left)) if left and not weight else rate * F.lit(scale)
            p = F.when(fixed | (F.col("tokens") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(spread, F.lit(0.0))))
            return at.select(*given, F.round(p, 9).alias("p"))
        cells = at.select(*given, (fixed | F.coalesce(rate * F.lit(scale) > 1, F.lit(False))).alias("fixed"))


def mix_documents(docs: DataFrame, targets: DataFrame | None = None, fraction: float = FRACTION, exponent: float = EXPONENT, sweeps: int = SWEEPS, topic: Column | None = None) -> DataFrame:
    """``docs`` with ``_topic``, ``_p`` and ``_keep``; without ``targets``, shares follow tokens to the power ``exponent``.

    ``topic`` may name ``doc_id``, ``text``, ``source`` and ``lang`` only; without it, :func:`topic_of` the text.
    """
    given, names = shielded(docs, ("doc_id", "text", "source", "lang"))
    plain = {"_source": F.col("source"), "_lang": F.col("lang"), "_topic": topic_of(F.col("text")) if topic is None else topic}
    marked = given.withColumns({k: F.coalesce(v.cast("string"), F.lit("")) for k, v in plain.items()})
    cells = cut(cells_of(marked.select(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS), n_tokens(F.col("text")).alias("tokens"))), "cells")
    cells = tempered(cells, exponent) if targets is None else with_targets(cells, targets)
    cells = calibrate(cells, fraction, sweeps).select(*(F.col(d).alias(f"_c_{d}") for d in DIMENSIONS), F.col("p").alias("_p"))
    # Written, the cells have a known size: Spark broadcasts them only below its threshold, else it splits a hot cell.
    cells = cut(cells, "cells")
    out = marked.join(cells, [F.col(f"_{d}") == F.col(f"_c_{d}") for d in DIMENSIONS], "left").withColumn("_p", F.coalesce("_p", F.lit(1.0)))
    out = out.withColumn("_keep", draw(F.col("doc_id"), F.col("text")) < F.col("_p"))
    made = ("_topic", "_p", "_keep")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in made), *made)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.round("_p", 6).alias("p"), F.col("_keep").alias("kept"))


def op10_sql() -> str:
    topic = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shout' WHEN contains(text, '### ') OR contains(text, '%%% ') THEN 'noise' WHEN length(text) < 400 THEN 'note' ELSE 'prose' END"
    each = lambda f, by=", ": by.join(f(x) for x in DIMENSIONS)
    state = f"{each(str)}, tokens, {each(lambda x: f'target_{x}')}"
    aimed, last = each(lambda x: f"target_{x} > 0", " AND "), 3 * SWEEPS
    goal = lambda x: f"greatest(0.0, budget * target_{x} - sum(held) OVER (PARTITION BY {x}))"
    step = lambda x: f"CASE WHEN sum(weight) OVER (PARTITION BY {x}) > 0 THEN weight * {goal(x)} / sum(weight) OVER (PARTITION BY {x}) ELSE 0.0 END"
    share = f"CASE WHEN fixed OR tokens = 0 THEN 1.0 WHEN sum(weight) OVER () > 0 THEN (budget - sum(held) OVER ()) * weight / sum(weight) OVER () / tokens WHEN {aimed} THEN (budget - sum(held) OVER ()) / sum(tokens - held) FILTER ({aimed}) OVER () ELSE 0.0 END"
    steps = [
        f"d AS (SELECT doc_id, source AS s0, lang AS l0, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::DOUBLE AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
        *(f"t_{x} AS (SELECT {x}, pow(sum(tokens), {EXPONENT}) / sum(pow(sum(tokens), {EXPONENT})) OVER () AS target_{x} FROM c GROUP BY {x})" for x in DIMENSIONS),
        # A round has the steps of all sweeps, then one that fixes cells; the last round fixes none.
        f"r AS (SELECT {state}, tokens AS weight, FALSE AS fixed, 1.0::DOUBLE AS p, 0 AS k, FALSE AS done FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)"
        f" UNION ALL SELECT {state}, CASE WHEN k < {last} THEN moved WHEN fixed OR share > 1 THEN 0.0 ELSE tokens END, fixed OR (k = {last} AND share > 1), share, (k + 1) % {last + 1}, k = {last} AND NOT bool_or(NOT fixed AND share > 1) OVER ()"
        f" FROM (SELECT *, CASE k % 3 WHEN 0 THEN {step('source')} WHEN 1 THEN {step('lang')} ELSE {step('topic')} END AS moved, {share} AS share"
        f" FROM (SELECT *, CASE WHEN fixed THEN tokens ELSE 0.0 END AS held, {FRACTION} * sum(tokens) OVER () AS budget FROM r WHERE NOT done)))",
        f"p AS (SELECT {each(str)}, round(CASE WHEN (SELECT sum(tokens) FROM c) > 0 THEN p ELSE 1.0 END, 9) AS p FROM r WHERE done)",
    ]
    u = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
    return f"WITH RECURSIVE {', '.join(steps)} SELECT doc_id, s0 AS source, l0 AS lang, topic, round(p, 6) AS p, {u} < p AS kept FROM d JOIN p USING (source, lang, topic)"
