"""Words that powers of one base would confuse, ids with many rows in a sample, account numbers, and texts of many matches."""

import time

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import common, decontaminate, jaccard_join, pii, toxicity


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_of_a_sequence_and_its_complement(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    hashes, _ = common.word_hashes([one.encode(), two.encode(), one.upper().encode(), b"a", b"b", b"aa"])
    assert hashes[0] == hashes[2] and len(np.unique(hashes)) == 5
    long, _ = common.word_hashes([thue_morse(1 << 14).encode(), (thue_morse(1 << 13) * 2).encode(), b"a"])
    assert len(np.unique(long)) == 3 and long[2] == hashes[3]
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (2, two, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard_join.keep_one(docs).count() == 2
    found = decontaminate.find_contamination(docs, spark.createDataFrame([("x", two)], "item_id string, text string"))
    assert {r.doc_id: r._n_hit for r in found.collect()} == {1: 0, 2: 1}


def test_an_id_trains_once(spark):
    docs = spark.range(60_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3, None)], "doc_id long, text string"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels, ["quality", "toxic"])
    assert rows.count() == 20 and rows.select("doc_id").distinct().count() == 20


def spans(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [[s.value for s in r._pii if s.kind == "iban"] for r in pii.find_pii(df).orderBy("doc_id").collect()]


def test_account_numbers_end_where_their_country_says(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    assert spans(spark, f"IBAN {gb} EUR", f"{gb} {de}", f"{de},{gb}", f"{de}X", "GB82 WEST 1234 5698 7654 33", "ZZ89370400440532013000", f"x{de}", f"FR7630006000011234567890189 {gb} END") == [[gb], [gb, de], [de, gb], [], [], [], [], ["FR7630006000011234567890189", gb]]


def test_texts_of_many_matches(spark):
    took = {}
    for n in (2_000, 60_000):
        df = spark.createDataFrame([(1, " ".join(f"u{i}@ex.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        row = pii.find_pii(df).select(F.size("_pii").alias("n"), F.element_at("_pii", -1).alias("last")).first()
        took[n] = time.time() - began
        assert row.n == n and row.last.value == f"u{n - 1}@ex.org"
    assert took[60_000] < 30
