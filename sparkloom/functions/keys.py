"""Keys and cursors: edge and reference keys as columns, page cursors and limits in plain Python."""

from __future__ import annotations

import base64
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page limits.
DEFAULT_LIMIT, MAX_LIMIT = 50, 200


class InvalidCursorError(ValueError):
    """A cursor that doesn't decode to a tuple of the wanted shape."""


def key_of(*parts: Column) -> Column:
    """A JSON array of strings, nulls kept: the identity of an edge or an unresolved reference."""
    return F.to_json(F.array(*(p.cast("string") for p in parts)))


def clamp_limit(limit: float | None) -> int:
    if limit is None or not math.isfinite(limit):
        return DEFAULT_LIMIT
    return min(MAX_LIMIT, max(1, math.floor(limit)))


def encode_cursor(values: tuple) -> str:
    raw = json.dumps(list(values), separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str, numeric: tuple[bool, ...]) -> tuple:
    """``numeric`` says for each slot whether it holds a number; all others hold strings."""
    try:
        values = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    except ValueError as e:
        raise InvalidCursorError(cursor) from e
    if not isinstance(values, list) or len(values) != len(numeric):
        raise InvalidCursorError(cursor)
    for v, n in zip(values, numeric, strict=True):
        if n != (isinstance(v, (int, float)) and not isinstance(v, bool)) or not (n or isinstance(v, str)):
            raise InvalidCursorError(cursor)
    return tuple(values)


def normalise_path(path: Column) -> Column:
    """POSIX path with ``.`` and ``..`` folded; ``..`` above the root is dropped."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))), "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.filter(F.split(path, r"[/\\]"), lambda p: p != ""), -1)


def specifier_kind(spec: Column) -> Column:
    return F.when(spec.startswith("."), "relative").when(spec.startswith("@/") | spec.startswith("~/"), "alias").otherwise("bare")


def package_name(spec: Column) -> Column:
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(parts[0])


def external_symbol(package: Column, name: Column) -> Column:
    """The id of a package's symbol: spaces of the package are doubled, names with other characters stand in backticks."""
    plain = name.rlike(r"^[A-Za-z0-9_+\-$]+$")
    quoted = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    return F.concat(F.lit("npm "), F.replace(package, F.lit(" "), F.lit("  ")), F.lit(" "), F.when(plain, name).otherwise(quoted), F.lit("."))


def external_id(package: str, name: str) -> str:
    """:func:`external_symbol` of plain strings, for code inside tasks."""
    plain = re.fullmatch(r"[A-Za-z0-9_+\-$]+", name)
    shown = name if plain else "`" + name.replace("`", "``") + "`"
    return f"npm {package.replace(' ', '  ')} {shown}."


def certainty_rank(resolution: Column, confidence: Column) -> Column:
    return F.when(resolution == "deterministic", 4).when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def backoff_ceiling(attempt: Column, base: float = 1.0, cap: float = 300.0) -> Column:
    """Seconds that a retry waits at most; full jitter draws below it."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
