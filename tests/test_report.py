"""The report of each project, and relative specifiers of every form."""

import json

import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from test_graph import SF

from sparkloom.operators import report
from sparkloom.plans import queries
from sparkloom.plans.graph import Graph

NODE = "project_id string, id string, kind string, sub_kind string"
EDGE = "project_id string, edge_key string, source_id string, target_id string, kind string, sub_kind string, resolution string, provenance_pass string"


def test_report_of_a_small_graph(spark):
    nodes = spark.createDataFrame([("p", "f", "file", None), ("p", "g", "file", None), ("p", "s", "symbol", "ts:function"), ("q", "r", "repo", None)], NODE)
    edges = spark.createDataFrame([("p", "1", "f", "g", "imports", None, "deterministic", "resolve"), ("p", "2", "f", "s", "imports", None, "inferred", "resolve"), ("p", "3", "f", "s", "calls", None, "inferred", "parse")], EDGE)
    tail = spark.createDataFrame([("p", "k", "unresolved-module"), ("t", "k", "ambiguous-export")], "project_id string, ref_key string, code string")
    files = spark.createDataFrame([("p", "analyzed"), ("p", "analyzed"), ("p", "skipped")], "project_id string, status string")
    found = {r.project_id: r for r in report.project_reports(Graph(nodes, edges, tail), files).collect()}
    assert sorted(found) == ["p", "q", "t"]
    assert found["p"].text.split("\n") == [
        "project: p", "files: analyzed=2 skipped=1", "nodes: file=2 symbol=1", "symbols: ts:function=1", "edges: calls=1 imports=2",
        "imports: total=3 deterministic=1 inferred=1 external=0 ambiguous=0 unresolved=1", "resolved_rate: 66.7%", "deterministic_share: 50.0%",
        "relations: renders_cross=0 renders_intra=0 calls_cross=0 calls_intra=1 prop_bindings_cross=0 prop_bindings_intra=0",
    ]
    of = json.loads(found["p"].json)
    assert (of["files"], of["edges"], of["imports"]["unresolved"], of["relations"]["calls_intra"]) == ({"analyzed": 2, "skipped": 1}, {"calls": 1, "imports": 2}, 1, 1)
    assert "edges: none" in found["q"].text and "resolved_rate: 0.0%" in found["q"].text and json.loads(found["q"].json)["edges"] == {}
    assert "nodes: none" in found["t"].text and json.loads(found["t"].json)["imports"]["ambiguous"] == 1
    none = Graph(nodes.filter(F.lit(False)), edges.filter(F.lit(False)), tail.filter(F.lit(False)))
    assert report.project_reports(none).collect() == []


@pytest.mark.parametrize("name", ["project_report", "relative_resolve", "signature_text"])
def test_query_against_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF)) == ""
