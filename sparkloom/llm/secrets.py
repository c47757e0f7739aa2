"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that they label.

The automata come from state merging (ALERGIA): credentials of one kind form a prefix tree whose states are merged,
in red-blue order, while Hoeffding's bound finds their symbol and end frequencies compatible. A second automaton is
inferred from ordinary long runs. All candidates are scored: what the fixed patterns find, every run of 12 or more
credential characters whole, and of a run that they cover in part also the parts that they leave, if these are as long.
The score is the log-likelihood ratio a character of the best kind's automaton (for a fixed pattern: its own kind's)
against the ordinary one. A run, or else its uncovered parts, become spans ``like_<kind>`` where they pass the level
that ``HIT`` of the labelled credentials reach; a run that fixed patterns cover from end to end adds none.

The automata are fitted on the ``SAMPLE`` strings of a kind (and ordinary runs that no pattern touches) of at most
``LONGEST`` characters that have the smallest hashes in all documents; a kind with none of these in the corpus gets no
automaton, and its fixed patterns' spans have null scores. All documents are scanned whole. Null and empty texts have no
spans. Repeated rows are scanned on their own. Other columns are kept, but for one named ``_spans``, which is replaced.
An empty table gives no rows. Positions are code points.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import add_columns, cut

#: Patterns (kind, regular expression, scored group, least characters of that group).
KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The same matches, found faster where a kind's failing matches cannot hide others.
SEARCH = {"access": re.compile(r"AKIA[A-Z0-9]{14,}"), "hex": re.compile(r"[0-9a-f]{16,}")}
NAMES = ("passw", "secret", "token", "api")
SHORTEST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
SYMBOLS = 66
SAMPLE, LONGEST, HIT, ALPHA = 400, 256, 0.95, 0.05


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, scored string) of the fixed patterns, in no order."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign" and not (("=" in text or ":" in text) and any(n in low for low in (text.lower(),) for n in NAMES)):
            continue
        for m in SEARCH.get(kind, pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), m[group]))
    return out


class Automaton:
    """A deterministic probabilistic automaton: per state its visits, ends and transitions (symbol: [target, count])."""

    def __init__(self, strings: list[str]):
        self.visits, self.ends, self.moves = [0], [0], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.moves[at]:
                    self.moves[at][c] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                step = self.moves[at][c]
                step[1] += 1
                at = step[0]
                self.visits[at] += 1
            self.ends[at] += 1

    def differ(self, a: int, n: int, b: int, m: int, bound: float) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, p: int, q: int, bound: float) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if self.differ(self.ends[p], n, self.ends[q], m, bound):
                return False
            mine, others = self.moves[p], self.moves[q]
            for c in mine.keys() | others.keys():
                a, b = mine.get(c, (None, 0)), others.get(c, (None, 0))
                if self.differ(a[1], n, b[1], m, bound):
                    return False
                if a[0] is not None and b[0] is not None:
                    todo.append((a[0], b[0]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to state ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.moves[q].items():
                if c in self.moves[p]:
                    self.moves[p][c][1] += n
                    todo.append((self.moves[p][c][0], to))
                else:
                    self.moves[p][c] = [to, n]

    def infer(self, alpha: float = ALPHA) -> Automaton:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            blue = min(((-self.visits[x[0]], x[0], r, c) for r in red for c, x in self.moves[r].items() if x[0] not in red), default=None)
            if blue is None:
                return self.compact(red)
            _, q, parent, c = blue
            for p in red:
                if self.compatible(p, q, bound):
                    self.moves[parent][c][0] = p
                    self.fold(p, q)
                    break
            else:
                red.append(q)

    def compact(self, red: list[int]) -> Automaton:
        new = {s: i for i, s in enumerate(red)}
        self.visits, self.ends = [self.visits[s] for s in red], [self.ends[s] for s in red]
        self.moves = [{c: [new[to], n] for c, (to, n) in self.moves[s].items()} for s in red]
        return self

    def table(self) -> list[tuple[dict[str, tuple[int, float]], float, float]]:
        """Per state: moves with log-probabilities, that of an unseen symbol, that of the end; smoothed by one symbol."""
        out = []
        for n, e, moves in zip(self.visits, self.ends, self.moves, strict=True):
            p = lambda k, n=n: math.log((k + 1 / (SYMBOLS + 1)) / (n + 1))
            out.append(({c: (to, p(k)) for c, (to, k) in moves.items()}, p(0), p(e)))
        return out


def likelihood(table: list, text: str) -> float:
    """Log-probability of a string; after an unseen symbol the start state goes on."""
    at, total = 0, 0.0
    for c in text:
        moves, unseen, _ = table[at]
        at, p = moves.get(c, (0, unseen))
        total += p
    return total + table[at][2]


def runs(text: str, base: list[tuple]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts that no base span covers) of all runs of credential characters."""
    taken = []
    for s, e in sorted((s, e) for s, _, e, _ in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    k = 0
    for m in RUN.finditer(text):
        at, free = m.start(), []
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        for s, e in itertools.takewhile(lambda t: t[0] < m.end(), itertools.islice(taken, k, None)):
            if at < s:
                free.append((at, s))
            at = e
        if at < m.end():
            free.append((at, m.end()))
        yield m.start(), m.end(), free


def least(values: set[str]) -> set[str]:
    """The ``SAMPLE`` strings with the smallest hashes."""
    return set(heapq.nsmallest(SAMPLE, values, key=lambda v: (digest(v), v)))


def digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value, hash) of base spans and of runs that none touches, in all documents; each task keeps the
    ``SAMPLE`` smallest hashes of a kind, among which are those of all tasks together."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = defaultdict(set)
        for batch in batches:
            for text in batch["text"]:
                base = base_spans(text)
                for _, r, _, v in base:
                    if len(v) <= LONGEST:
                        held[KINDS[r][0]].add(v)
                held["ordinary"].update(text[s:e] for s, e, free in runs(text, base) if free == [(s, e)] and e - s <= LONGEST)
                for kind, values in held.items():
                    if len(values) > 8 * SAMPLE:
                        held[kind] = least(values)
        rows = [(kind, v, digest(v)) for kind, values in sorted(held.items()) for v in sorted(least(values))]
        yield pd.DataFrame(rows, columns=["kind", "value", "hash"])

    return docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInPandas(scan, "kind string, value string, hash long")


def infer_automata(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[list, float]]:
    """By kind: the table of its automaton and the least score; under "ordinary" the one to compare with."""
    found = cut(labelled(docs, text_col), "credentials").distinct()
    samples = {}
    for kind in (*(k[0] for k in KINDS), "ordinary"):
        rows = found.filter(F.col("kind") == kind).orderBy("hash", "value").limit(SAMPLE).collect()
        samples[kind] = [r.value for r in rows]
    ordinary = Automaton(samples.pop("ordinary")).infer().table()
    out = {"ordinary": (ordinary, 0.0)}
    for kind, strings in samples.items():
        if strings:
            table = Automaton(strings).infer().table()
            scores = sorted(((likelihood(table, s) - likelihood(ordinary, s)) / len(s) for s in strings), reverse=True)
            out[kind] = (table, max(0.5, scores[math.ceil(HIT * len(scores)) - 1]))
    return out


def find_secrets(docs: DataFrame, automata: dict | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: array<struct<kind, start, end, score>> by start, then kind."""
    automata = infer_automata(docs, text_col) if automata is None else automata
    ordinary = automata["ordinary"][0]
    kinds = [k[0] for k in KINDS]

    def ratio(kind: str, value: str) -> float:
        return (likelihood(automata[kind][0], value) - likelihood(ordinary, value)) / len(value)

    def like(text: str, start: int, end: int) -> tuple | None:
        """The span of a candidate whose best kind's score passes that kind's level."""
        against, n = likelihood(ordinary, text[start:end]), end - start
        score, rank = max(((likelihood(automata[k][0], text[start:end]) - against) / n, -r) for r, k in enumerate(kinds) if k in automata)
        return (start, len(kinds) - rank, end, score) if score >= automata[kinds[-rank]][1] else None

    def compute(texts: list[str | None]) -> dict[str, list]:
        out = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            spans = [(s, r, e, ratio(kinds[r], v) if kinds[r] in automata else None) for s, r, e, v in base]
            for s, e, free in runs(text, base) if len(automata) > 1 else ():
                if free:
                    found = [like(text, s, e)]
                    if found == [None] and free != [(s, e)]:
                        found = [like(text, *part) for part in free if part[1] - part[0] >= SHORTEST]
                    spans += [x for x in found if x]
            spans.sort(key=lambda x: x[:3])
            out.append([{"kind": kinds[r] if r < len(kinds) else "like_" + kinds[r - len(kinds)], "start": s, "end": e, "score": x} for s, r, e, x in spans])
        return {"_spans": out}

    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    return add_columns(docs, text_col, {"_spans": ("array<struct<kind:string,start:int,end:int,score:double>>", pa.list_(span))}, compute)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("_spans", lambda s: ~s["kind"].startswith("like_"))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k[0]).alias(f"n_{k[0]}") for k in KINDS), F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("_spans", name)).alias("spans"))


def brute_force(text: str | None) -> list[str]:
    """The base spans straight from the patterns' definition, for tests."""
    given = {"assign": r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    found = defaultdict(list)
    for rank, (kind, _, group, least) in enumerate(KINDS):
        for m in re.finditer(given[kind], text or ""):
            if len(m[1] if group else m[0]) >= least:
                found[m.start(), rank].append(f"{kind}:{m.start()}:{m.end()}")
    return [x for k in sorted(found) for x in found[k]]
