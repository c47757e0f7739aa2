"""Ignore files of a tree, nested ones too: patterns become regular expressions, and the last match of the deepest file
that matches decides.

Within one file, a path below an ignored folder is ignored whatever later rules say of the path; else the last rule that
matches it ignores it, or with ``!`` takes it back. Over the files above a path, the deepest one with a verdict holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = ".gitignore"
#: Parts of a pattern: escaped character, class, ``**/`` of whole segments, ``/**`` at the end, stars, and the rest.
PART = r"\\.|\[(?:\\.|[^\]\\])+\]|(?<![^/])\*\*/|/\*\*$|\*+|.|\n"


def class_of(text: Column) -> Column:
    """A bracket expression; ranges that run backwards hold nothing."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^\[[!^]?", ""), r"\]$", "")
    kept = F.filter(F.regexp_extract_all(inner, F.lit(r"\\.|[^\\]-[^\\]|."), F.lit(0)), lambda x: ~(x.rlike("^.-.$") & (F.substring(x, 1, 1) > F.substring(x, 3, 1))))
    safe = F.array_join(F.transform(kept, lambda x: F.when(x.rlike(r"^\\"), x).otherwise(F.regexp_replace(x, r"([\[\]&^~])", r"\\$1"))), "")
    negated = text.rlike(r"^\[[!^]")
    return F.when(safe == "", F.when(negated, ".").otherwise("(?!)")).otherwise(F.concat(F.when(negated, "[^").otherwise("["), safe, F.lit("]")))


def pattern_of(rule: Column) -> Column:
    """The regular expression of a rule without its ``!``, over paths whose folders end in a slash."""
    bare = F.regexp_replace(rule, "/$", "")
    anchored = bare.contains("/")
    body = F.regexp_replace(bare, "^/", "")
    parts = F.regexp_extract_all(body, F.lit(PART), F.lit(0))
    edge = lambda i: (i < 1) | (i > F.size(parts)) | (F.get(parts, i - 1) == "/") | F.coalesce(F.get(parts, i - 1) == "**/", F.lit(False))

    def one(x: Column, i: Column) -> Column:
        quoted = F.regexp_replace(x, r"([^A-Za-z0-9_\u0080-\uffff])", r"\\$1")
        whole = edge(i) & edge(i + 2)  # a star that is a segment of its own needs a character
        stars = F.when(whole, "[^/]+").otherwise("[^/]*")
        return F.when(x.rlike(r"^\\."), F.regexp_replace(F.substring(x, 2, 1), r"([^A-Za-z0-9_\u0080-\uffff])", r"\\$1")).when(x.rlike(r"^\[.+\]$"), class_of(x)).when(x == "**/", "(?:[^/]+/)*").when(x == "/**", "/.+").when(x.startswith("*"), stars).when(x == "?", "[^/]").otherwise(quoted)

    text = F.array_join(F.transform(parts, one), "")
    return F.concat(F.lit("(?is)"), F.when(anchored, "^").otherwise("(?:^|/)"), text, F.when(rule.endswith("/"), "/$").otherwise("/?$"))


def rules(sources: DataFrame) -> DataFrame:
    """``project_id, dir, rules`` of ``sources(project_id, dir, text)``: structs ``(negated, pattern)`` in their order."""
    line = F.regexp_replace(F.regexp_replace("line", "\r$", ""), r"(?<!\\)\s+$", "")
    lines = sources.select("project_id", "dir", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("project_id", "dir", "at", line.alias("line"))
    lines = lines.filter(~F.col("line").rlike(r"^(\s*$|#|!?/?$)"))
    negated = F.startswith("line", F.lit("!"))
    made = F.struct("at", negated.alias("negated"), pattern_of(F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line"))).alias("pattern"))
    return lines.groupBy("project_id", "dir").agg(F.array_sort(F.collect_list(made)).alias("rules"))


def with_ignored(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files(project_id, path, ...)`` with ``ignored``.

    Folders are judged once for all the files below them: each distinct prefix meets the ignore files above it, by
    equality of folders.
    """
    parts = F.split("path", "/")
    up = lambda c, n: F.array_join(F.slice(c, F.lit(1), n), "/")
    paths = files.select("project_id", "path").distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(up(parts, k), F.when(k < F.size(parts), "/").otherwise("")))
    prefixes = paths.select("project_id", "path", F.explode(steps).alias("prefix"))
    depth = F.size(F.split(F.regexp_replace("prefix", "/$", ""), "/"))
    above = F.concat(F.array(F.lit("")), F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda k: up(F.split("prefix", "/"), k))).otherwise(F.array().cast("array<string>")))
    spots = prefixes.select("project_id", "prefix").distinct().select("project_id", "prefix", F.explode(above).alias("dir"))
    below = F.when(F.col("dir") == "", F.col("prefix")).otherwise(F.expr("substring(prefix, length(dir) + 2)"))
    last = F.try_element_at(F.filter("rules", lambda r: F.regexp(below, r["pattern"])), F.lit(-1))
    judged = spots.join(rules(sources), ["project_id", "dir"]).select("project_id", "prefix", "dir", (~last["negated"]).alias("out")).filter("out IS NOT NULL")
    # A folder's verdict holds for what is below it only if it ignores.
    met = prefixes.join(judged, ["project_id", "prefix"]).filter((F.col("prefix") == F.col("path")) | F.col("out"))
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    verdicts = met.groupBy("project_id", "path", "dir").agg(F.min_by("out", F.length("prefix")).alias("out"))
    final = verdicts.groupBy("project_id", "path").agg(F.max_by("out", level).alias("_out"))
    return files.join(final, ["project_id", "path"], "left").withColumn("ignored", F.coalesce("_out", F.lit(False))).select(*files.columns, "ignored")
