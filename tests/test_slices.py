"""What a run holds on disk is a slice's tables and its result; of later nodes only those that enlarge are walked from."""

import json
import os

from pyspark.sql import functions as F

from genmeta.operators import editor, graph, passes
from genmeta.plans import dispatch, tables


def folders(spark):
    base = f"{tables.shared_folder(spark)}/genmeta".removeprefix("file://")
    return {f"{run}/{t}" for run in os.listdir(base) for t in os.listdir(f"{base}/{run}")} if os.path.isdir(base) else set()


def test_files_are_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(tables, "SLICE", 100)
    before, seen = folders(spark), []

    def run(scratch, files):
        held = scratch.written(files.withColumn("text", F.upper("text")), "held")
        seen.append(({r["file_id"] for r in held.collect()}, sum(f.endswith("-held") for f in folders(spark) - before)))
        return held

    rows = [(i // 2, "ä" * 10) for i in range(40)]  # 800 bytes, two chunks a file
    found = tables.sliced(spark.createDataFrame(rows, "file_id long, text string"), "whole", run)
    assert len(seen) == 9 and all(n == 1 for _, n in seen)  # only this slice's table is there
    assert sum(len(files) for files, _ in seen) == 20 and set().union(*(files for files, _ in seen)) == set(range(20))
    assert sorted(map(tuple, found.collect())) == sorted((i, t.upper()) for i, t in rows)
    assert all(f.endswith("-whole") for f in folders(spark) - before)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_no_chunks_give_no_rows(spark):
    empty = spark.createDataFrame([], "file_id long, text string")
    assert tables.sliced(empty, "none", lambda scratch, files: files).count() == 0


def sampler(seed, pos):
    return {"class_type": "KSampler", "inputs": {"seed": seed, "sampler_name": "euler", "positive": [pos, 0], "latent_image": ["5", 0]}}


def test_graphs_in_slices_leave_their_records_alone(spark, monkeypatch):
    graphs = [(i, json.dumps({"3": sampler(i, "6"), "6": {"class_type": "CLIPTextEncode", "inputs": {"text": f"fox {i}"}}, "9": {"class_type": "SaveImage", "inputs": {"images": ["3", 0]}}})) for i in range(4)]
    monkeypatch.setattr(tables, "SLICE", sum(len(t) for _, t in graphs) // 2 + 1)
    before = folders(spark)
    found = graph.records(spark.createDataFrame(graphs, "file_id long, text string"))
    assert {(r["file_id"], r["seed"], r["prompt"]) for r in found.collect()} == {(i, i, f"fox {i}") for i in range(4)}
    assert sorted(f.rsplit("-", 1)[1] for f in folders(spark) - before) == ["graphs", "graphs"]


def test_canvases_in_slices_leave_their_records_alone(spark, monkeypatch):
    rows = [(i, json.dumps({"nodes": [{"id": 1, "type": "KSampler", "inputs": [], "widgets_values": [i, "fixed", 9, 7.5, "euler", "normal", 1]}], "links": []})) for i in range(4)]
    monkeypatch.setattr(tables, "SLICE", sum(len(t) for _, t in rows) // 2 + 1)
    before = folders(spark)
    found = editor.records(spark.createDataFrame(rows, "file_id long, text string"))
    assert {(r["file_id"], r["seed"], r["steps"]) for r in found.collect()} == {(i, i, 9) for i in range(4)}
    assert sorted(f.rsplit("-", 1)[1] for f in folders(spark) - before) == ["canvases", "canvases"]


def test_information_in_slices_leaves_its_rows_alone(spark, monkeypatch):
    text = lambda i: f"a fox {i}\nSteps: 2, Sampler: Euler, CFG scale: 3, Seed: {i}, Size: 64x64"
    rows = [(i, 0, "parameters", text(i)) for i in range(4)]
    monkeypatch.setattr(tables, "SLICE", sum(len(t) for *_, t in rows) // 2 + 1)
    before = folders(spark)
    found = dispatch.image_info(spark.createDataFrame(rows, "file_id long, ord int, chunk_key string, text string"))
    assert {(r["file_id"], r["seed"], r["prompt"]) for r in found.collect()} == {(i, i, f"a fox {i}") for i in range(4)}
    assert {f.rsplit("-", 1)[1] for f in folders(spark) - before} == {"info"}


def test_later_nodes_are_those_that_enlarge(spark):
    """Nodes 14 to 16 come after the pass, and only 14 holds a factor."""
    nodes = {
        "3": sampler(1, "6"), "5": {"class_type": "EmptyLatentImage", "inputs": {"width": 64}}, "6": {"class_type": "CLIPTextEncode", "inputs": {"text": "fox"}},
        "14": {"class_type": "LatentUpscaleBy", "inputs": {"samples": ["3", 0], "scale_by": 2}}, "15": {"class_type": "Sharpen", "inputs": {"samples": ["14", 0]}},
        "16": {"class_type": "VAEDecode", "inputs": {"samples": ["15", 0]}}, "9": {"class_type": "SaveImage", "inputs": {"images": ["16", 0]}},
    }
    rows = graph.inputs(spark.createDataFrame([(1, json.dumps(nodes))], "file_id long, text string"))
    none = spark.createDataFrame([], "file_id long, node string")
    enlarging = passes.of_upscales(rows).select("file_id", F.col("node_id").alias("node"))
    found = passes.scoped(passes.files(rows), graph.sampling_candidates(rows), none, none, enlarging).first()
    assert (found["root"], found["primary"], [tuple(n) for n in found["later"]]) == ("9", "3", [("14", 3)])
    assert set(found["scope"]) == {"3", "5", "6"} and set(found["above"]) == set(nodes) - {"9"}
