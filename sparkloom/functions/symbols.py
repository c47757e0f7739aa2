"""Symbol ids: descriptor paths of names with suffixes, for external symbols behind a manager and a package.

A name of other characters than letters, digits and ``_+-$`` stands in backticks, its own backticks doubled. Spaces of
a manager or package are doubled, so two single spaces outside backticks part the three fields. Everything here is made
of built-in functions; an id that breaks the grammar gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of one character, and the kinds of descriptors.
SUFFIXES = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}
METHOD, LOCAL, PARAMETER, TYPE_PARAMETER = "method", "local", "parameter", "type-parameter"
PLAIN = r"[A-Za-z0-9_+\-$]+"
NAME = rf"(?:{PLAIN}|`(?:``|[^`])++`)"
DESCRIPTOR = rf"(?:\({NAME}\)|\[{NAME}\]|{NAME}(?:[/#.:!]|\([^)]*\)\.|~[^~]*~))"
FIELD = r"((?:`[^`]*+`|  |[^ `])++)"
#: The type of a parsed id.
SYMBOL = "struct<manager: string, package: string, descriptors: array<struct<name: string, suffix: string, disambiguator: string>>>"


def named(text: Column) -> Column:
    """The name that a name of the grammar stands for."""
    return F.when(text.startswith("`"), F.replace(F.regexp_replace(text, "^`|`$", ""), F.lit("``"), F.lit("`"))).otherwise(text)


def descriptor(text: Column) -> Column:
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    inner = F.coalesce(part(rf"^[(\[]({NAME})[)\]]$"), part(rf"^({NAME})"))
    last = F.substring(text, -1, 1)
    simple = F.element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), last)
    method = text.rlike(rf"^{NAME}\(")
    suffix = F.when(text.startswith("("), PARAMETER).when(text.startswith("["), TYPE_PARAMETER).when(method, METHOD).when(last == "~", LOCAL).otherwise(simple)
    more = F.when(suffix == METHOD, part(rf"^{NAME}\(([^)]*)\)\.$")).when(suffix == LOCAL, part(rf"^{NAME}~([^~]*)~$"))
    return F.struct(named(inner).alias("name"), suffix.alias("suffix"), more.alias("disambiguator"))


def parse_symbol(symbol: Column) -> Column:
    """``struct(manager, package, descriptors)``; local ids have neither manager nor package."""
    outside = symbol.rlike(f"^{FIELD} {FIELD} {FIELD}$")
    field = lambda i: F.when(outside, F.regexp_extract(symbol, f"^{FIELD} {FIELD} {FIELD}$", i))
    single = lambda c: F.regexp_replace(c, r"(`[^`]*+`)|( ) ", "$1$2")
    path = single(F.when(outside, field(3)).when(symbol.rlike(f"^{FIELD}$"), symbol))
    sound = path.rlike(f"^{DESCRIPTOR}+$") & (~outside | ~(field(1).contains("`") | field(2).contains("`")))
    parts = F.transform(F.regexp_extract_all(path, F.lit(DESCRIPTOR), F.lit(0)), descriptor)
    return F.when(sound, F.struct(single(field(1)).alias("manager"), single(field(2)).alias("package"), parts.alias("descriptors")))


def is_external(symbol: Column) -> Column:
    """Whether an id names a symbol of a package; malformed ids don't."""
    return F.coalesce(parse_symbol(symbol)["manager"].isNotNull(), F.lit(False))


def quoted(name: Column) -> Column:
    return F.when(name.rlike(f"^{PLAIN}$"), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def format_symbol(symbol: Column) -> Column:
    """The id of a :data:`SYMBOL`; null where a name is empty, a suffix unknown, or a package only half given."""

    def one(d: Column) -> Column:
        name, more = quoted(d["name"]), F.coalesce(d["disambiguator"], F.lit(""))
        tail = F.element_at(F.create_map(*(F.lit(x) for k, v in SUFFIXES.items() for x in (v, k))), d["suffix"])
        wrapped = F.when(d["suffix"] == METHOD, F.concat(name, F.lit("("), more, F.lit(")."))).when(d["suffix"] == LOCAL, F.concat(name, F.lit("~"), more, F.lit("~")))
        wrapped = wrapped.when(d["suffix"] == PARAMETER, F.concat(F.lit("("), name, F.lit(")"))).when(d["suffix"] == TYPE_PARAMETER, F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(name, tail))
        return F.when(F.length(d["name"]) > 0, wrapped)

    manager, package, parts = symbol["manager"], symbol["package"], F.transform(symbol["descriptors"], one)
    path = F.when((F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    doubled = lambda c: F.when((F.length(c) > 0) & ~c.contains("`"), F.replace(c, F.lit(" "), F.lit("  ")))
    return F.when(manager.isNull() & package.isNull(), path).otherwise(F.concat(doubled(manager), F.lit(" "), doubled(package), F.lit(" "), path))
