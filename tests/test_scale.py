"""Work is dealt over tasks, and what Spark takes for the size of a table is about what its rows take in memory."""

import json

from pyspark.sql import functions as F

from genmeta.operators import graph, json_records, passes
from genmeta.plans import tables


def test_graphs_of_one_task_are_dealt_over_all(spark):
    rows = [(i, json.dumps({"1": {"class_type": "A", "inputs": {"x": i, "y": ["2", 0]}}, "2": {"class_type": "B", "inputs": 3}, "3": 4})) for i in range(64)]
    found = graph.inputs(spark.createDataFrame(rows, "file_id long, text string").coalesce(1))
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert {tuple(r) for r in found.select("node_id", "class_type", "has_inputs", "input_name", "kind", "link_node").distinct().collect()} == {("1", "A", True, "x", "literal", None), ("1", "A", True, "y", "link", "2"), ("2", "B", False, None, None, None)}


def test_estimated_size_of_repeated_rows(spark):
    n = 200_000
    held = tables.written(spark.range(n).select((F.col("id") % 100).alias("file_id"), F.lit("CheckpointLoaderSimple").alias("class_type")), "repeated")
    estimated = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimated >= n * (8 + len("CheckpointLoaderSimple"))


def test_roots_take_one_job_and_no_tables(spark, monkeypatch):
    """The root that most nodes lead to, over a diamond, a cycle and a missing node; nothing goes through tables of rounds."""
    monkeypatch.setattr(tables, "stored", None)
    link = lambda *to: {f"i{k}": [t, 0] for k, t in enumerate(to)}
    node = lambda cls, *to: {"class_type": cls, "inputs": link(*to)}
    graphs = {
        1: {"1": node("A"), "2": node("A", "1"), "3": node("A", "1"), "8": node("SaveImage", "1"), "9": node("SaveImage", "2", "3", "77")},
        2: {"1": node("A", "2"), "2": node("A", "1"), "5": node("PreviewImage", "1"), "6": node("PreviewImage", "1")}, 3: {"4": node("saver", "4")}, 4: {"4": node("A", "4")},
    }
    rows = graph.inputs(spark.createDataFrame([(k, json.dumps(g)) for k, g in graphs.items()], "file_id long, text string"))
    assert {tuple(r) for r in passes.roots(passes.files(rows)).collect()} == {(1, "9", 3), (2, "5", 2), (3, "4", 0)}


def test_records_of_one_task_are_dealt_over_all(spark):
    rows = [(i, "Comment", json.dumps({"positive_prompt": f"p{i}", "seed": i})) for i in range(64)]
    found = json_records.records(spark.createDataFrame(rows, "file_id long, chunk_key string, text string").coalesce(1))
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert {(r["file_id"], r["prompt"], r["seed"]) for r in found.collect()} == {(i, f"p{i}", i) for i in range(64)}
