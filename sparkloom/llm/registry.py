"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.decontaminate import op6_decontaminate
from sparkloom.llm.jaccard_join import op1_jaccard_join
from sparkloom.llm.merkle import op13_merkle, op13_sql
from sparkloom.llm.mixing import op10_mixing, op10_sql
from sparkloom.llm.neighbours import op8_neighbours
from sparkloom.llm.pii import op9_pii
from sparkloom.llm.prefix_trie import op11_prefix_trie, op11_sql
from sparkloom.llm.secrets import op7_secrets
from sparkloom.llm.sharding import op12_sharding, op12_sql
from sparkloom.llm.token_counts import op4_token_counts
from sparkloom.llm.token_files import op2_token_files
from sparkloom.llm.toxicity import op5_toxicity
from sparkloom.llm.warc import op3_sql, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_token_files": op2_token_files,
        "op3_warc": op3_warc,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_secrets": op7_secrets,
        "op8_neighbours": op8_neighbours,
        "op9_pii": op9_pii,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_sharding": op12_sharding,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": op3_sql(), "op10_mixing": op10_sql(), "op11_prefix_trie": op11_sql(), "op12_sharding": op12_sql(), "op13_merkle": op13_sql()}
