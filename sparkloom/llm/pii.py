"""Personal data in texts, in DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for account numbers), and words
just before a span adjust its score. Positions are code points, end exclusive: with the pieces between matches and
the matches themselves, both in order, running lengths give each match's place.

Null and empty texts have no spans. Repeated rows are scanned on their own. All other columns are kept,
but for one named ``_pii``, which is replaced.

The patterns begin with ``\\G`` or a look-behind and repeat possessively. They match what the plain patterns in
``PLAIN`` match, without scanning a long run again from each of its characters and without recursion.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns, kinds in the order of reports.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The length of account numbers by country.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNTS.items()) + r")(?![A-Za-z0-9])",
}
#: What a text must hold for any match of the kind; texts without it skip the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"}
#: Scores without context, and words that raise them when they stand in the 40 characters before.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = {"email": "mail|contact", "ip": "ip|host|server|address", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank"}
BONUS, REACH, BLOCK = 0.1, 40, 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    chars = F.split(F.reverse(digits(value)), "")
    each = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, leaves 1."""
    v = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substring(v, 5, 99), F.substring(v, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c <= "9", (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def byte_parts(value: Column) -> Column:
    """Whether all parts between full stops are numbers of at most 255."""
    small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255))


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": byte_parts(value), "card": n.between(14, 19) & luhn(value), "phone": n.between(10, 15), "iban": mod97(value)}[kind]


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, rank, end, kind, value, score>> of the confirmed matches of one kind."""
    found = F.regexp_extract_all(text, F.lit(FAST[kind]), F.lit(0))
    gaps = F.transform(F.split(text, FAST[kind], -1), lambda g: F.struct(F.length(g).alias("n"), F.lower(F.right(g, F.lit(REACH))).alias("before")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    rank = list(FAST).index(kind)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]["n"]
        end = start + F.length(pair["value"])
        score = F.lit(SCORE[kind]) + F.when(pair["gap"]["before"].rlike(rf"\b(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0)
        row = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"), F.round(score, 2).alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, pair["value"]), F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array(none).alias("out"))
    walk = lambda acc, block: F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    def in_blocks(p: Column) -> Column:
        # Appending copies an array; blocks keep that short in texts with many matches.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
        return F.aggregate(F.when(F.size(p) > 0, blocks).otherwise(F.array(p)), start, walk, lambda acc: F.flatten(acc["out"]))

    # The pairs are an element of a list, so that a text is matched once and not for every block.
    walked = F.element_at(F.transform(F.array(pairs), in_blocks), 1)
    return F.when(text.rlike(NEEDS[kind]), walked).otherwise(begin["out"])


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_pii``: all confirmed spans by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("_pii", F.array_sort(F.concat(*(spans_of(kind, text) for kind in FAST))))


def redact(docs: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Replace each span that scores at least ``min_score`` by its kind in angle brackets.

    Of overlapping spans the one that starts first is replaced; null texts stay null.
    """
    found = find_pii(docs, text_col)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        use = (s["start"] >= acc["at"]) & (s["score"] >= min_score)
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(use, s["end"]).otherwise(acc["at"]).alias("at"), F.when(use, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_pii", begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(text.isNull(), text).otherwise(done)).drop("_pii")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("_pii", lambda s: s["kind"] != "iban")
    count = lambda k: F.size(F.filter("_pii", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in PLAIN), F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("_pii", name)).alias("spans"), F.concat_ws(",", F.transform("_pii", lambda s: s["score"].cast("string"))).alias("scores"))


def brute_force(text: str | None) -> dict:
    """The base spans with Python's regular expressions, for tests."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return {"spans": [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)], **{f"n_{k}": sum(x[2] == k for x in out) for k in PLAIN}}
