"""Prefix trie, shards and Merkle manifest against plain Python, on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import merkle, prefix_trie, sharding

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie ---


def trie(sequences):
    """Nodes of {conv_id: [(role, text)]} from all prefixes."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for key, ids in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(key))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=lambda r: r[:2])


def nodes(df):
    return sorted((tuple(r[n] for n, _ in prefix_trie.NODE) for r in df.collect()), key=lambda r: r[:2])


def test_trie_of_copies_over_many_ranges(spark):
    rng = random.Random(3)
    hot = [("user", "hi"), ("assistant", "yo"), ("user", "é")]
    sequences = {c: hot if c % 3 else [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randrange(6))] for c in range(-60, 400)}
    rows = [(c, [(hashlib.sha256(repr(t).encode()).digest(), len(t[1].encode())) for t in turns]) for c, turns in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<symbol: binary, bytes: int>>").repartition(3)
    assert nodes(prefix_trie.prefix_trie(df)) == trie(sequences)


def test_trie_of_odd_turns(spark):
    turns = [(1, 2, "u", "b"), (1, None, None, "first"), (1, 1, "u", None), (7, 5, "u", "x"), (7, 5, "u", "x"), (None, 1, "u", "lost"), (-3, 1, "", "first"), (8, 1, "u", "z" * 100_000)]
    df = spark.createDataFrame([(*t, "x", 5) for t in turns], "conv_id long, turn long, role string, text string, symbols string, _base int")
    got = nodes(prefix_trie.prefix_trie(prefix_trie.sequences(df)))
    assert got == trie({1: [("", "first"), ("u", ""), ("u", "b")], 7: [("u", "x"), ("u", "x")], -3: [("", "first")], 8: [("u", "z" * 100_000)]})
    # 10 gives its first turns to 12, as many as it has; 13's base is absent; without turns of its own nothing is left.
    crc = {c: zlib.crc32(str(c).encode()) % 9 for c in (10, 12, 23)}
    table = [(10, t, "u", f"base{t}") for t in range(2)] + [(12, t, "u", f"own{t}") for t in range(crc[12] + 2)] + [(23, 0, "u", "gone")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    c = F.col("conv_id")
    made = prefix_trie.rebuilt(df, c - c % 5, (F.crc32(c.cast("string")) % 9).cast("int"))
    want = {10: [("u", "base0"), ("u", "base1")], 12: [("u", f"base{t}") for t in range(min(2, crc[12]))] + [("u", f"own{t}") for t in range(crc[12], crc[12] + 2)], 23: [("u", "gone")][crc[23] :]}
    assert nodes(prefix_trie.prefix_trie(made)) == trie(want)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(df.limit(0))).count() == 0


def test_merge_of_many_runs():
    rng = random.Random(5)
    for k in (0, 1, 2, 5, 9):
        rows = [([rng.choice([b"a", b"b"]) for _ in range(rng.randrange(5))], i, []) for i in range(k * 7)]
        runs = [prefix_trie.front_coded([r for r in rows if r[1] % k == j]) for j in range(k)]
        got, last = list(prefix_trie.merge(runs)), []
        assert [(r[1], r[2]) for r in got] == sorted((r[0], r[1]) for r in rows)
        for n, key, _, _ in got:
            assert n == prefix_trie.shared(last, key)
            last = key


# --- shards ---


def even_cuts(sizes, k):
    """Capacity by trying every one, and the cuts by the rule, on all boundaries."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    total = ends[-1]

    def fits(c):
        pos = 0
        for _ in range(k):
            pos = max(e for e in ends if e <= pos + c)
        return pos == total

    c = next(c for c in range(max(sizes), total + 1) if fits(c))
    need = [total]
    for _ in range(k - 1):
        need.append(min(e for e in ends if e >= need[-1] - c))
    out, pos = [], 0
    for i, most in enumerate(reversed(need)):
        want = pos + (total - pos) // (k - i)
        a, b = max(e for e in ends if e <= want), min(e for e in ends if e >= want)
        following = min([e for e in ends if e > pos] or [total])
        pos = min(max(a if want - a <= b - want else b, most, following), max(e for e in ends if e <= pos + c))
        out.append(pos)
    return c, out


def test_capacity_search_with_few_marks(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        sizes = [rng.choice([1, 2, 3, rng.randint(1, 50), rng.randint(1, 600) if rng.random() < 0.1 else 4]) for _ in range(rng.randint(1, 60))]
        k, marks = rng.randint(1, 8), rng.choice([2, 4, 16])
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

        def look(spans, ends=ends, marks=marks):
            width, held = max(1, -(-sum(b - a for a, b in spans) // marks)), defaultdict(list)
            for i, (a, b) in enumerate(spans):
                for e in ends:
                    if a < e < b:
                        held[i, (e - a) // width].append(e)
            return [(min(v), max(v), len(v)) for v in held.values()]

        assert sharding.minimax_cuts(look, ends[-1], max(sizes), k) == even_cuts(sizes, k)


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MARKS", 8)
    texts = ["hot"] * 200 + [None, "", "", "é", "long " * 30_000] + [f"text {i % 40}" for i in range(120)]
    rows = [(None if i % 50 == 7 else i // 2, t, "clash") for i, t in enumerate(texts)] + [(5, "hot", "clash")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sharding.shard(df, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    groups = defaultdict(int)
    for _, t, _ in rows:
        groups[sha(t or "")] += len((t or "").encode()) + 1
    capacity, ends = even_cuts([groups[d] for d in sorted(groups)], 4)
    filled = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert filled == [b - a for a, b in zip([0, *ends], ends, strict=False)] and max(filled) == capacity
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(df.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard(df.filter("text = 'hot'"), 4).collect()} == {0}


# --- Merkle manifest ---


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def run_tree(level):
    """All levels of a tree over digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)``, each with siblings taken by position."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(enc, r))), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: run_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = run_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = sha("".join(map(enc, (*r[:4], r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))))) if forged else leaf
            proof = ""
            for tree, i in ((trees[s], at), (top, k)):
                for level in tree[:-1]:
                    a, b = "".join(level[i // 16 * 16 : i]), "".join(level[i + 1 : i // 16 * 16 + 16])
                    proof, node, i = proof + a + b, sha(a + node + b), i // 16
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return Counter(out)


def manifest(df):
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = merkle.manifest(df, picked, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)})
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in made.collect())


def test_manifest_of_odd_rows(spark):
    rows = [(i, "big", "en", i, f"Text {i}" if i % 2 else f"text {i}") for i in range(4_400)]  # more than 16 blocks
    rows += [(None, "s", None, None, "A"), (3, "s", "de", 1, None), (3, "s", "de", 1, None), (3, "s", "de", 1, ""), (2**60 + 1, "s", "de", 1, "É A"), (8, None, "de", 1, "B"), (9, "", "de", 1, "C" * 200_000)]
    rows += [(10_000 + i, f"src{i}", "fr", 1, "Lone") for i in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    got = manifest(df)
    assert got == plain_manifest(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([(4, None, None, None, "Z")], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(df) == plain_manifest([(4, None, None, None, "Z")])
    assert manifest(df.limit(0)) == Counter()
