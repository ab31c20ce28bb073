"""The metadata operators: SQL oracles on small tables, goldens for edge rules, and images built here."""

import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from genmeta import catalog
from genmeta.functions import text as T
from genmeta.operators import blocks, graph, json_records
from genmeta.plans import dispatch
from genmeta.sources import images
from genmeta.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row]) for row in rows)


@pytest.fixture(scope="module")
def shared():
    """Queries over one recipe share its records, which are tables: a run costs many small jobs."""
    known, kept = {}, (graph.records, dispatch.image_info)

    def once(f):
        def found(chunks):
            key = f.__name__, chunks._jdf.queryExecution().analyzed().semanticHash()
            if key not in known:
                known[key] = f(chunks)
            return known[key]

        return found

    graph.records, dispatch.image_info = map(once, kept)
    yield
    graph.records, dispatch.image_info = kept


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, shared, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(columns).collect()) == plain(want.fetchall())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value,result", [("12", 12), (" -1x", -1), ("18446744073709551615", None), ("abc", None), (None, None)])
def test_seed(spark, value, result):
    assert one(spark, value, T.parse_seed(F.col("v"))) == result


@pytest.mark.parametrize("value,result", [("512x768", "2:3"), ("0x5", None), ("5x", None), ("99999999999x1", None)])
def test_ratio(spark, value, result):
    w, h = T.sides(F.col("v"))
    assert one(spark, value, T.aspect_ratio(w, h)) == result


@pytest.mark.parametrize("value,result", [("1e1", 10.0), ("7.5 and more", 7.5), (" -.5e-1x", -0.05), ("5.", 5.0), (".", 0.0), ("e5", 0.0), ("2e", 2.0), (None, None)])
def test_leading_double(spark, value, result):
    assert one(spark, value, T.leading_double(F.col("v"))) == result


def test_quoted_pieces(spark):
    assert one(spark, 'a: 1, b: "x, y", c: z,w', blocks.pieces(F.col("v"))) == ["a: 1", 'b: "x, y"', "c: z,w"]


def test_block_without_settings_line(spark):
    rows = blocks.records(spark.createDataFrame([(1, "parameters", "a cat\nSteps: 5, Seed: 3")], "file_id int, chunk_key string, text string")).first()
    assert (rows["prompt"], rows["steps"], rows["seed"]) == ("a cat", 5, 3)


@pytest.mark.parametrize(
    "line,model,lora",
    [
        ('Civitai resources: [{"type":"lora","modelName":"l"},{"type":"checkpoint","modelName":"base"}]', "base", None),
        ('Model: own, Civitai resources: [{"type":"checkpoint","modelName":"base"}]', "own", None),
        ('Civitai resources: [{"type":"checkpoint"},{"type":"checkpoint","modelName":"late"}]', None, None),
        ('Civitai resources: broken, Hashes: {"LORA:b": "1", "model": "2", "LORA:a": "3"}', None, "a, b"),
        ('Lora hashes: "x: 12", Hashes: {"LORA:b": "1"}', None, "x"),
        ('Hashes: {"LORA:b": {"x": {}}, "model": "2", "LORA:a": "1"}, Clip skip: 2', None, "a, b"),
        ('Loras: foo, Lora hashes: "a: 1"', None, "foo"),
    ],
)
def test_resources_and_hashes(spark, line, model, lora):
    rows = blocks.records(spark.createDataFrame([(1, "parameters", f"a cat\nSteps: 5, Sampler: Euler, Seed: 3, {line}")], "file_id int, chunk_key string, text string")).first()
    assert (rows["model"], rows["lora"], rows["steps"], rows["seed"]) == (model, lora, 5, 3)


@pytest.mark.parametrize(
    "prompt,line,lora",
    [
        ("<lora:x:0.5> <lora:x:0.8>", "", "x: 0.5"),
        ("<lora:a/x:1> b", 'Lora hashes: "b/x: 12, x: 13"', "a/x: 1, b/x"),
        ("<lora:x>, <lyco:y:>, <lora:z:0.125:2>, <lora: :1>", "", "x, y, z: 0.125"),
        ("<lora:x:strong>", 'Lora hashes: "X.safetensors: 1"', "x: strong"),
        ("<lora:x:1>", 'Loras: foo, Lora hashes: "a: 1"', "x: 1, a"),
        ("[<lora:x:1>", 'Lora hashes: "a: 1"', "a"),
        ("cat", 'Lora hashes: "a: 1", Clip skip: 2, Lora hashes: "b: 2, c: d: 3"', "a, b, c: d"),
    ],
)
def test_merged_loras(spark, prompt, line, lora):
    rows = blocks.records(spark.createDataFrame([(1, "parameters", f"{prompt}\nSteps: 5, Sampler: Euler, Seed: 3, {line}")], "file_id int, chunk_key string, text string")).first()
    assert rows["lora"] == lora


def test_resource_name_with_bracket(spark):
    line = 'Civitai resources: [{"type":"checkpoint","modelName":"base] one"}]'
    rows = blocks.records(spark.createDataFrame([(1, "parameters", f"a cat\nSteps: 5, Sampler: Euler, Seed: 3, {line}")], "file_id int, chunk_key string, text string")).first()
    assert rows["model"] == "base] one"


def test_json_records_of_rare_shapes(spark):
    texts = [
        '{"negative_prompt":"a hall, Infinity mirror, NaN","positive_prompt":"say \\"NaN\\"","seed":1,"cfg_scale":NaN,"x":[-Infinity, Infinity]}',
        '{"prompt":"p","activated_loras":["dir/one.safetensors","two",3],"loras_multipliers":"0.5  1.25","model_filename":"https://h/base_model.safetensors","model_type":"t2v","resolution":"832x480"}',
        '{"prompt":"p","cfgscale":6,"loras":"a, b,,c","loraweights":"0.50, x"}',
        '{"prompt":"p","use_stable_diffusion_model":"m","use_lora_model":"style"}',
    ]
    rows = {r["generator"]: r for r in json_records.records(spark.createDataFrame([(i, "Comment", t) for i, t in enumerate(texts)], "file_id int, chunk_key string, text string")).collect()}
    assert rows["InvokeAI"]["negative_prompt"] == "a hall, Infinity mirror, NaN" and rows["InvokeAI"]["prompt"] == 'say "NaN"' and rows["InvokeAI"]["cfg_scale"] == 0
    assert (rows["WanGP"]["model"], rows["WanGP"]["size"], rows["WanGP"]["lora"]) == ("base_model", "832x480", "one.safetensors: 0.5, two: 1.25")
    assert rows["SwarmUI"]["lora"] == "a: 0.5, b: x, c" and rows["Easy Diffusion"]["lora"] == "style"


def test_search_hits(spark):
    assert catalog.search_prompts(spark, SF).count() > 0


def test_closure_with_cycle(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "a")], "file_id int, dst string, src string")
    got = graph.closure(links, spark.createDataFrame([(1, "a"), (2, "a")], "file_id int, node string")).collect()
    assert sorted((r["file_id"], r["node"]) for r in got) == [(1, "b"), (1, "c")]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + b"".join(chunks) + chunk(b"IEND", b"")


TEXT = b"a red fox\nNegative prompt: dull\nSteps: 20, Sampler: Euler a, CFG scale: 7, Seed: 42, Size: 512x768, Model: m.safetensors"


def tiff(value):
    data = b"UNICODE\0" + value.encode("utf-16-le")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x9286, 7, len(data), 26) + struct.pack("<I", 0) + data


@pytest.fixture()
def lake(tmp_path):
    files = {
        "a.png": png(chunk(b"tEXt", b"parameters\0" + TEXT)), "b.PNG": png(chunk(b"zTXt", b"parameters\0\0" + zlib.compress(TEXT))), "c.png": png(chunk(b"iTXt", b"parameters\0\0\0\0\0" + TEXT)),
        "d.jpg": b"\xff\xd8" + b"\xff\xff\xe1" + struct.pack(">H", len(tiff(TEXT.decode())) + 8) + b"Exif\0\0" + tiff(TEXT.decode()) + b"\xff\xda", "e.tiff": tiff(TEXT.decode()),
        "f.webp": b"RIFF" + b"\0" * 4 + b"WEBP" + b"EXIF" + struct.pack("<I", len(tiff(TEXT.decode()))) + tiff(TEXT.decode()), "cut.png": png(chunk(b"tEXt", b"parameters\0" + TEXT))[:60], "note.txt": b"not an image at all", "tiny.png": b"\x89PNG",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_images(spark, lake):
    rows = images.chunks(images.split_frames(images.scan(spark, str(lake)))).withColumnRenamed("path", "file_id")
    info = {r["file_id"].rsplit("/", 1)[1]: r for r in dispatch.image_info(rows).collect()}
    assert sorted(info) == ["a.png", "b.PNG", "c.png", "d.jpg", "e.tiff", "f.webp"]
    assert {(r["prompt"], r["negative_prompt"], r["seed"], r["model"], r["aspect_ratio"]) for r in info.values()} == {("a red fox", "dull", 42, "m", "2:3")}


def test_stream(spark, lake, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(x)) for x in ("catalog", "state"))
    query = ingest.stream(spark, str(lake), out, state)
    query.awaitTermination(120)
    assert ingest.latest_rows(spark.read.parquet(out)).count() == 6
