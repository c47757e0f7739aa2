"""Documentation comments: description and tags, word for word, by folding lines with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the language whose comments these are, and what isn't.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"
TAG = rf"^@(\w+){SPACE}*(.*)$"
LINK = rf"\{{@link{SPACE}+([^}}|{SPACES}]+)(?:[{SPACES}|][^}}]*)?\}}"
DOC = "struct<description: string, tags: array<struct<tag: string, text: string>>>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def parse_doc(raw: Column) -> Column:
    """``struct(description, tags)`` of a comment, null where nothing is left without its fence and margins.

    A tag takes the lines after it, up to the next tag; an inline link becomes the name that it links to.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, rf"^{SPACE}*/\*\*?", ""), rf"\*/{SPACE}*\z", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{SPACE}*\*{SPACE}?", ""), rf"{SPACE}+\z", ""))
    cleaned = trimmed(F.array_join(lines, "\n"))
    start = F.struct(F.array().cast("array<string>").alias("free"), F.array().cast("array<struct<tag: string, text: string>>").alias("tags"))

    def fold(done: Column, line: Column) -> Column:
        free, tags = done["free"], done["tags"]
        new = F.struct(F.regexp_extract(line, TAG, 1).alias("tag"), F.regexp_extract(line, TAG, 2).alias("text"))
        last = F.try_element_at(tags, F.lit(-1))
        longer = F.struct(last["tag"].alias("tag"), trimmed(F.concat(last["text"], F.lit(" "), trimmed(line))).alias("text"))
        is_tag, in_tag = line.rlike(TAG), F.size(tags) > 0
        more = F.when(is_tag, F.array_append(tags, new)).when(in_tag, F.array_append(F.slice(tags, F.lit(1), F.size(tags) - 1), longer)).otherwise(tags)
        return F.struct(F.when(is_tag | in_tag, free).otherwise(F.array_append(free, line)).alias("free"), more.alias("tags"))

    bare_links = lambda c: F.regexp_replace(c, LINK, "$1")
    done = F.aggregate(F.split(cleaned, "\n"), start, fold)
    tags = F.transform(done["tags"], lambda t: F.struct(t["tag"].alias("tag"), bare_links(t["text"]).alias("text")))
    return F.when(cleaned != "", F.struct(bare_links(trimmed(F.array_join(done["free"], "\n"))).alias("description"), tags.alias("tags")))
