"""Copy-on-write commits, conflicts, and two processes that write at once."""

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from test_graph import got, graph

from sparkloom.operators import reads
from sparkloom.operators.queue import JOB, Queue
from sparkloom.plans.graph import Graph
from sparkloom.sources import store


def rows(spark, *r):
    return spark.createDataFrame(list(r), "project_id string, v long")


def test_graphs_are_saved_whole_or_by_project(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.load(spark, root)
    g = graph(spark, [("f", "file", None, "f")], ["f -contains-> x"], [("unbound-callee", None, "n")])
    store.save(g, root)
    assert store.load(spark, root).payload is None
    args = spark.createDataFrame([("p", "c", 0, "x", "named")], "project_id string, id string, pos int, arg_name string, pass_kind string")
    both = Graph(g.nodes.unionByName(g.nodes.withColumn("project_id", F.lit("q"))), g.edges, g.tail, args)
    assert store.save(both, root) == 2
    stored = store.load(spark, root)
    assert stored.edges.count() == 1 and stored.nodes.count() == 2 and reads.call_bindings(stored).count() == 1
    assert store.save_project(graph(spark, [("new", "file", None, "new")], []), root, "p") == 3
    assert got(store.load(spark, root).nodes, "project_id", "id") == [("p", "new"), ("q", "f")]
    assert store.load(spark, root, "p").edges.count() == 0 and store.load(spark, root, seq=2).edges.count() == 1
    assert store.load(spark, root, "q").nodes.columns == g.nodes.columns


def test_replacing_one_of_many_writes_one_folder(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.replace({"t": spark.range(200).select(F.format_string("%03d", F.col("id") % 100).alias("project_id"), F.col("id").alias("v"))})
    before = s.view()
    s.replace({"t": rows(spark, ("007", -1), ("008", -2))}, ["007", "050"])  # 008 isn't asked for; 050 ends empty
    folders = [d for d in os.listdir(tmp_path / "t") if not d.startswith("snapshot=" + before.manifest.first().snapshot)]
    assert [x for d in folders for x in os.listdir(tmp_path / "t" / d) if "=" in x] == ["project_id=007"]
    now = s.read()["t"]
    assert got(now.filter("project_id IN ('006', '007', '008', '050')"), "project_id", "v") == [("006", 6), ("006", 106), ("007", -1), ("008", 8), ("008", 108)]
    assert s.read(before)["t"].count() == 200 and s.read(keys=["007"])["t"].count() == 1
    assert len(s.read(keys=["007"])["t"].inputFiles()) == 1
    assert s.read(keys=["none"])["t"].count() == 0
    assert s.replace({"t": rows(spark, ("x", 1))}, whole=True) == 3 and s.read()["t"].count() == 1


def test_changes_start_over_after_another_commit(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.replace({"t": rows(spark, ("a", 1), ("b", 1))})
    runs = []

    def add(tables):
        runs.append(1)
        if len(runs) == 1:
            s.replace({"t": rows(spark, ("a", 10))}, ["a"])
            s.replace({"t": rows(spark, ("b", 10))}, ["b"])
        return {"t": tables["t"].withColumn("v", F.col("v") + 1)}

    assert s.update(["a"], add) == 4 and len(runs) == 2
    assert got(s.read()["t"], "project_id", "v") == [("a", 11), ("b", 10)]

    def late(tables):
        s.replace({"t": rows(spark, ("b", len(runs)))}, ["b"])  # another key is no conflict
        return {"t": tables["t"]}

    assert s.update(["a"], late) == 6

    def beaten(tables):
        s.replace({"t": rows(spark, ("a", 0))}, ["a"])
        return tables

    with pytest.raises(store.ConflictError):
        s.update(["a"], beaten, attempts=2)


def test_many_commits_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    s = store.Store(spark, str(tmp_path))
    for i in range(8):
        s.replace({"t": rows(spark, (f"k{i % 5}", i))})
    assert s.view().folded <= 3 and s.view().seq == 8
    assert got(s.read()["t"], "project_id", "v") == [("k0", 5), ("k1", 6), ("k2", 7), ("k3", 3), ("k4", 4)]
    assert got(s.read(s.view(5))["t"], "v") == [(0,), (1,), (2,), (3,), (4,)]


def test_a_file_is_created_once(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.once.link./top", f"file://{tmp_path}")
    os.makedirs(tmp_path / "x")
    for place in (str(tmp_path), f"file://{tmp_path}/x", "viewfs://once/top"):
        path = f"{place}/{len(place)}.json"
        assert store.create_once(spark, path, "first") and not store.create_once(spark, path, "second")
        assert spark.read.text(path).first()[0] == "first"
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".") and not f.endswith(".crc")]


def test_opening_leaves_what_others_write(spark, tmp_path):
    """Writers that opened a store at the same time used to delete each other's temporary folder."""
    os.makedirs(other := tmp_path / "commits" / "_temporary" / "0")
    assert store.Store(spark, str(tmp_path)).view().seq == 0
    assert other.exists() and os.listdir(tmp_path / "commits") == ["_temporary"]
    with ThreadPoolExecutor(8) as pool:
        assert [s.view().seq for s in pool.map(lambda _: store.Store(spark, str(tmp_path / "new")), range(8))] == [0] * 8


WORKER = """
import sys
from pyspark.sql import SparkSession, functions as F
from sparkloom.operators.queue import Queue
from sparkloom.sources.store import Store
root, me = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
q, now = Queue(spark, root + "/queue"), F.to_timestamp(F.lit("2024-01-02 00:00:00"))
for i in range(3):
    print("won", *(r.id for r in q.claim(now, 3).collect()), flush=True)
    Store(spark, root + "/graph").replace({"t": spark.createDataFrame([(f"{me}{i}", i)], "project_id string, v long")})
"""


def test_two_processes_claim_and_save(spark, tmp_path):
    q = Queue(spark, str(tmp_path / "queue"))
    made = spark.range(30).select("id", F.lit(None).cast("string").alias("dedupe_key"), F.lit("ready").alias("status"), F.lit(0).alias("attempts"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("available_at"), F.lit(None).cast("timestamp").alias("lease_until"))
    q.put(made)
    store.Store(spark, str(tmp_path / "graph"))
    workers = [subprocess.Popen([sys.executable, "-c", WORKER, str(tmp_path), me], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for me in "ab"]
    out = [w.communicate(timeout=240)[0] for w in workers]
    won = [int(x) for text in out for line in text.splitlines() if line.startswith("won") for x in line.split()[1:]]
    assert sorted(won) == list(range(18))
    assert got(q.jobs().groupBy("status").count(), "status", "count") == [("processing", 18), ("ready", 12)]
    s = store.Store(spark, str(tmp_path / "graph"))
    assert s.view().seq == 6 and got(s.read()["t"], "project_id") == [(f"{me}{i}",) for me in "ab" for i in range(3)]
    q.settle(spark.createDataFrame([(i, i % 2 == 0) for i in won], "id long, ok boolean"), F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    assert q.jobs().filter("status = 'done'").count() == 9
    assert q.jobs().schema.simpleString() == spark.createDataFrame([], JOB).schema.simpleString()
