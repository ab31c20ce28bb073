"""Registered queries of the metadata operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import text as T
from .operators import blocks, editor, graph, json_records, passes
from .plans import dispatch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def duck(recipe: str) -> str:
    return recipe.replace("AS STRING)", "AS VARCHAR)")


# --- DuckDB's form of the block parser -----------------------------------------------------------------------------------
PARSED = rf"""
WITH chunks AS ({duck(X.BLOCKS)}), parts AS (
 SELECT file_id, text, string_split(text, chr(10))[-1] AS line,
  CASE WHEN instr(text, chr(10) || 'Negative prompt:') > 0 THEN instr(text, chr(10) || 'Negative prompt:') + 1 END AS neg FROM chunks
), cut AS (
 SELECT *, length(text) - length(line) + 1 AS at_,
  list_transform(list_filter(list_transform(regexp_extract_all(line, '(?:[^",]|"(?:\\.|[^"\\])*"|,[^ ])+'), lambda p: ltrim(p)), lambda p: contains(p, ': ')),
   lambda p: {{'k': string_split(p, ': ')[1], 'v': trim(p[instr(p, ': ') + 2:])}}) AS kv FROM parts
), got AS (
 SELECT file_id, text, kv, nullif(trim(substring(text, 1, coalesce(neg, at_) - 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS prompt,
  CASE WHEN neg IS NOT NULL THEN nullif(trim(substring(text, neg + 16, at_ - neg - 16), ' ' || chr(9) || chr(10) || chr(13)), '') END AS negative_prompt,
  list_filter(kv, lambda e: e.k = 'Version')[-1].v AS version, list_filter(kv, lambda e: e.k = 'Sampler')[-1].v AS sampler_text,
  list_filter(kv, lambda e: e.k = 'Size')[-1].v AS size FROM cut
), record AS (
 SELECT file_id, prompt,
  CASE WHEN lower(version) = 'comfyui' AND negative_prompt = prompt THEN NULL ELSE negative_prompt END AS negative_prompt,
  CASE WHEN lower(version) = 'comfyui' THEN 'ComfyUI' WHEN regexp_matches(version, '^f[0-9]') THEN 'Forge' ELSE 'Automatic1111' END AS generator,
  CASE WHEN lower(version) = 'comfyui' AND regexp_matches(sampler_text, '(?i)[ _](simple|normal|karras|exponential|sgd_uniform|ddim_uniform|beta|linear_quadratic|kl_optimal)$') THEN regexp_extract(sampler_text, '^(.*)[ _][^ _]+$', 1) ELSE sampler_text END AS sampler,
  CASE WHEN lower(version) = 'comfyui' AND regexp_matches(sampler_text, '(?i)[ _](simple|normal|karras|exponential|sgd_uniform|ddim_uniform|beta|linear_quadratic|kl_optimal)$') THEN regexp_extract(sampler_text, '[ _]([^ _]+)$', 1) END AS scheduler,
  CAST(list_filter(kv, lambda e: e.k = 'Steps')[-1].v AS INTEGER) AS steps, CAST(list_filter(kv, lambda e: e.k = 'CFG scale')[-1].v AS DOUBLE) AS cfg_scale,
  CAST(list_filter(kv, lambda e: e.k = 'Seed')[-1].v AS BIGINT) AS seed, size,
  regexp_replace(list_filter(kv, lambda e: e.k = 'Model')[-1].v, '(?i)^(.+)\.(safetensors|ckpt|pt|pth|bin|gguf)$', '\1') AS model,
  CAST(string_split(size, 'x')[1] AS INTEGER) AS w, CAST(string_split(size, 'x')[2] AS INTEGER) AS h,
  regexp_extract(prompt, '<lora:([^:>]*):', 1) AS tag, CAST(regexp_extract(prompt, '<lora:[^:>]*:([^>]*)>', 1) AS DOUBLE) AS tag_weight FROM got
)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.records(X.view(spark, sf_dir, X.BLOCKS))


@register(PARSED + "SELECT generator, model, sampler, count(*) AS images, avg(steps) AS avg_steps FROM record GROUP BY ALL ORDER BY images DESC, generator, model, sampler LIMIT 10")
def generators_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent (generator, model, sampler), a top-k report."""
    grouped = _records(spark, sf_dir).groupBy("generator", "model", "sampler").agg(F.count("*").alias("images"), F.avg("steps").alias("avg_steps"))
    return grouped.orderBy(F.desc("images"), "generator", "model", "sampler").limit(10)


@register(PARSED + "SELECT file_id, prompt, negative_prompt FROM record")
def block_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A5, A14."""
    return _records(spark, sf_dir).select("file_id", "prompt", "negative_prompt")


@register(PARSED + "SELECT file_id, generator, sampler, scheduler, steps, cfg_scale, seed, model FROM record")
def block_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6-A13, M9."""
    return _records(spark, sf_dir).select("file_id", "generator", "sampler", "scheduler", "steps", "cfg_scale", "seed", "model")


@register(PARSED + "SELECT file_id, size, CAST(w / gcd(w, h) AS INTEGER) || ':' || CAST(h / gcd(w, h) AS INTEGER) AS aspect_ratio, round(CAST(w AS DOUBLE) * h / 1e6 * 100) / 100 AS megapixels FROM record")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3."""
    return _records(spark, sf_dir).select("file_id", "size", "aspect_ratio", "megapixels")


@register(PARSED + "SELECT file_id, tag || ': ' || rtrim(rtrim(CAST(CAST(tag_weight AS DECIMAL(12, 6)) AS VARCHAR), '0'), '.') || ', extra' AS lora, 2 AS lora_count FROM record")
def block_loras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag names first, then names of hashes that no tag has."""
    return _records(spark, sf_dir).select("file_id", "lora", "lora_count")


@register(rf"""WITH chunks AS ({duck(X.BLOCKS)}) SELECT file_id, unnest(range(len(p))) AS pos, unnest(list_transform(p, lambda x: ltrim(x))) AS piece
 FROM (SELECT file_id, regexp_extract_all(string_split(text, chr(10))[-1], '(?:[^",]|"(?:\\.|[^"\\])*"|,[^ ])+') AS p FROM chunks)""")
def block_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    rows = X.view(spark, sf_dir, X.BLOCKS)
    return rows.select("file_id", F.posexplode(blocks.pieces(F.element_at(F.split("text", "\n"), -1))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


JSON_SQL = f"""
WITH chunks AS ({duck(X.JSONS)}), j AS (SELECT file_id, CAST(text AS JSON) AS d, text FROM chunks), u AS (SELECT file_id, text, coalesce(d -> '$.sui_image_params', d) AS d FROM j)
SELECT file_id, CASE WHEN (d -> '$.positive_prompt') IS NOT NULL THEN 'InvokeAI' WHEN (d -> '$.cfgscale') IS NOT NULL THEN 'SwarmUI' ELSE 'NovelAI' END AS generator,
 coalesce(d ->> '$.positive_prompt', d ->> '$.prompt') AS prompt, coalesce(d ->> '$.negative_prompt', d ->> '$.uc') AS negative_prompt, d ->> '$.model.name' AS model,
 regexp_replace(d ->> '$.model.hash', '^blake3:', '') AS model_hash, TRY_CAST(d ->> '$.seed' AS BIGINT) AS seed, TRY_CAST(coalesce(d ->> '$.cfg_scale', d ->> '$.cfgscale', d ->> '$.scale') AS DOUBLE) AS cfg_scale,
 TRY_CAST(d ->> '$.steps' AS INTEGER) AS steps, CASE WHEN CAST(d ->> '$.width' AS INTEGER) > 0 THEN (d ->> '$.width') || 'x' || (d ->> '$.height') END AS size,
 CASE WHEN (d -> '$.positive_prompt') IS NOT NULL THEN 'x: 0.12' WHEN (d -> '$.cfgscale') IS NOT NULL THEN 'a: 0.5, b: 1' END AS lora, abs(CAST(d ->> '$.clipstopatlayer' AS INTEGER)) AS clip_skip FROM u
"""


@register(JSON_SQL)
def json_records_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, J0-J3, J6, J8, J9, J11."""
    return json_records.records(X.view(spark, sf_dir, X.JSONS)).select("file_id", "generator", "prompt", "negative_prompt", "model", "model_hash", "seed", "cfg_scale", "steps", "size", "lora", "clip_skip")


@register("""SELECT event_id, CASE WHEN json_type(j, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR regexp_matches(j ->> '$.k', '^\\s*[+-]?[0-9.]+\\s*$') THEN TRY_CAST(j ->> '$.k' AS DOUBLE) END AS k FROM (SELECT event_id, CAST(props AS JSON) AS j FROM events)""")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", json_records.number(F.try_parse_json("props"), F.lit("$.k")).try_cast("double").alias("k"))


@register("""SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS trimmed, strlen(text) >= 15 AND NOT regexp_matches(text, '0x[0-9A-Fa-f]{5}') AND NOT regexp_matches(text, '^[{\\[]')
 AND NOT starts_with(text, 'CREATOR:') AND NOT starts_with(text, 'File written by') AND NOT starts_with(text, 'Generated by') AND NOT contains(text, 'JPEG Library')
 AND len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n,]'), lambda w: w <> '')) >= 4 AS generated, regexp_matches(text, '^[ \\t\\r\\n]*[{\\[]') AS is_blob, contains(lower(text), 'the') AS has_the FROM documents""".replace("\\\\", "\\"))
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C10, C11, C13 over all documents."""
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.trim_blank(text).alias("trimmed"), T.looks_generated(text).alias("generated"), T.is_blob(text).alias("is_blob"), T.contains_ci(text, "The").alias("has_the"))


@register("""SELECT conv_id, turn, role, strlen(text) >= 15 AND NOT regexp_matches(text, '0x[0-9A-Fa-f]{5}') AND NOT regexp_matches(text, '^[{\\[]') AND NOT starts_with(text, 'CREATOR:')
 AND NOT starts_with(text, 'File written by') AND NOT starts_with(text, 'Generated by') AND NOT contains(text, 'JPEG Library') AND len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n,]'), lambda w: w <> '')) >= 4 AS generated FROM conversations""".replace("\\\\", "\\"))
def conversation_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 over all turns."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", T.looks_generated(F.col("text")).alias("generated"))


@register("""WITH s AS (SELECT p_partkey, 256 + 64 * (p_size % 20) AS w, 256 + 64 * (p_partkey % 13) AS h FROM part)
 SELECT p_partkey, w || 'x' || h AS size, CAST(w / gcd(w, h) AS INTEGER) || ':' || CAST(h / gcd(w, h) AS INTEGER) AS aspect_ratio, round(CAST(w AS DOUBLE) * h / 1e6 * 100) / 100 AS megapixels FROM s""")
def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat((256 + 64 * (F.col("p_size") % 20)).cast("string"), F.lit("x"), (256 + 64 * (F.col("p_partkey") % 13)).cast("string")).alias("size"))
    w, h = T.sides(F.col("size"))
    return part.select("p_partkey", "size", T.aspect_ratio(w, h).alias("aspect_ratio"), T.megapixels(w, h).alias("megapixels"))


@register("""WITH s AS (SELECT p_partkey, CAST(p_size % 16 + 1 AS DOUBLE) AS rw, CAST(p_partkey % 9 + 1 AS DOUBLE) AS rh, CAST(p_size AS DOUBLE) / 10 AS mp FROM part), t AS (SELECT *, sqrt(mp * 1024.0::DOUBLE * 1024.0::DOUBLE / (rw * rh)) AS k FROM s)
 SELECT p_partkey, CAST(round_even(rw * k / 64, 0) * 64 AS INTEGER) || 'x' || CAST(round_even(rh * k / 64, 0) * 64 AS INTEGER) AS size FROM t""")
def resolution_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G29."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ratio = lambda c, n: (F.col(c) % n + 1).cast("double")
    return part.select("p_partkey", T.formula_size(ratio("p_size", 16), ratio("p_partkey", 9), F.col("p_size").cast("double") / 10, 64).alias("size"))


@register(f"""WITH p AS ({duck(X.PACKETS)}), d AS (SELECT file_id, regexp_extract(packet, '<rdf:li[^>]*>(.*?)</rdf:li>', 1, 's') AS li, regexp_extract(packet, '<exif:UserComment>(.*?)</exif:UserComment>', 1, 's') AS uc FROM p)
 SELECT file_id, replace(replace(replace(replace(replace(replace(li, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#10;', chr(10)), '&#13;', chr(13)), '&amp;', '&') AS description, uc AS user_comment FROM d""")
def xmp_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13-S15."""
    packet = F.col("packet")
    value = lambda tag: T.unescape_xml(T.first_list_item(T.first_tag(packet, tag)))
    return X.view(spark, sf_dir, X.PACKETS).select("file_id", value("dc:description").alias("description"), value("exif:UserComment").alias("user_comment"))


@register("SELECT page_id, CASE WHEN instr(html, '<title>') > 0 AND instr(html[instr(html, '<title>') + 7:], '</title>') > 0 THEN html[instr(html, '<title>') + 7:][:instr(html[instr(html, '<title>') + 7:], '</title>') - 1] END AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal tag search over web pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.first_tag(F.col("html"), "title").alias("title"))


@register(f"""WITH f AS ({duck(X.FILES)}), r AS (SELECT *, lower(path) AS path_key, row_number() OVER (PARTITION BY lower(path) ORDER BY modification_time DESC, event_id DESC) AS n FROM f) SELECT path_key, event_id, modification_time, length FROM r WHERE n = 1""")
def files_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, T2."""
    return dispatch.latest(X.view(spark, sf_dir, X.FILES)).select("path_key", "event_id", "modification_time", "length")


@register(f"""WITH f AS ({duck(X.FILES)}), c AS (SELECT * FROM f WHERE event_id % 3 <> 0) SELECT event_id, path, length FROM f WHERE length >= 12 AND NOT EXISTS (SELECT 1 FROM c WHERE lower(c.path) = lower(f.path) AND c.modification_time = f.modification_time AND c.length = f.length)""")
def files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 12 bytes or more whose stamp the last catalog lacks."""
    files = X.view(spark, sf_dir, X.FILES)
    return dispatch.changed(files.filter("length >= 12"), files.filter("event_id % 3 <> 0")).select("event_id", "path", "length")


CLOSURE_SQL = f"""WITH RECURSIVE e AS ({duck(X.EDGES)}), c(file_id, start, node) AS (SELECT file_id, dst, src FROM e UNION SELECT c.file_id, c.start, e.src FROM c JOIN e ON e.file_id = c.file_id AND e.dst = c.node)
 SELECT file_id, start, count(*) AS n_ancestors FROM c WHERE node <> start GROUP BY file_id, start"""


@register(CLOSURE_SQL)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 over all line items."""
    links = X.view(spark, sf_dir, X.EDGES)
    reached = graph.closure(links, links.select("file_id", F.col("dst").alias("node")).distinct())
    return reached.groupBy("file_id", "start").agg(F.count("*").alias("n_ancestors"))


GRAPH_SQL = f"WITH chunks AS ({duck(X.GRAPHS)}), nodes AS (SELECT file_id, n.key AS node_id, n.value ->> '$.class_type' AS class_type, n.value -> '$.inputs' AS inputs FROM chunks, json_each(chunks.text) AS n)"


@register(GRAPH_SQL + """ SELECT file_id, node_id, class_type, i.key AS input_name, CASE WHEN json_type(i.value) = 'ARRAY' THEN 'link' ELSE 'literal' END AS kind, CASE WHEN json_type(i.value) = 'ARRAY' THEN i.value ->> '$[0]' END AS link_node,
 CASE WHEN json_type(i.value) = 'ARRAY' THEN CAST(i.value ->> '$[1]' AS INTEGER) END AS link_slot FROM nodes, json_each(nodes.inputs) AS i""")
def graph_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2."""
    return graph.inputs(X.view(spark, sf_dir, X.GRAPHS)).filter("input_name IS NOT NULL").select("file_id", "node_id", "class_type", "input_name", "kind", "link_node", "link_slot")


@register(f"SELECT o_orderkey AS file_id, '9' AS root, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 9 END AS BIGINT) AS n_ancestors FROM orders")
def graph_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved output and the number of nodes that it depends on."""
    return passes.roots(passes.files(graph.inputs(X.view(spark, sf_dir, X.GRAPHS))))


@register(f"SELECT o_orderkey AS file_id, '3' AS node FROM orders")
def graph_samplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return graph.sampling_candidates(graph.inputs(X.view(spark, sf_dir, X.GRAPHS)))


@register("""SELECT o_orderkey AS file_id, o_orderkey * 31 AS seed, CAST(o_custkey % 40 + 1 AS INTEGER) AS steps, 7.5::DOUBLE AS cfg_scale, 1.0::DOUBLE AS denoising_strength, 'euler' AS sampler, 'normal' AS scheduler, 'm' || (o_custkey % 10) AS model, '512x768' AS size FROM orders""")
def graph_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, G25, G28, M9, J3."""
    return graph.records(X.view(spark, sf_dir, X.GRAPHS)).select("file_id", "seed", "steps", "cfg_scale", "denoising_strength", "sampler", "scheduler", "model", "size")


@register("""SELECT o_orderkey AS file_id, 'a ' || o_orderstatus || ', ' || CASE WHEN o_orderkey % 4 = 0 THEN '[TextGenerate]' ELSE 'cust ' || o_custkey END AS prompt, 'low ' || o_orderpriority AS negative_prompt, o_orderkey % 4 = 0 AS partial FROM orders""")
def graph_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts resolved through joins and passes, with markers for parts only known at run time."""
    return graph.records(X.view(spark, sf_dir, X.GRAPHS)).select("file_id", "prompt", "negative_prompt", "partial")


@register("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey + 7 ELSE o_orderkey END AS seed, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 9 ELSE 20 END AS INTEGER) AS steps, CASE WHEN o_orderkey % 3 = 2 THEN 'heun' ELSE 'euler' END AS sampler,
 CASE WHEN o_orderkey % 3 = 2 THEN 'own ' || o_orderkey WHEN o_custkey % 2 = 0 OR o_custkey % 3 = 0 THEN 'first ' || o_custkey ELSE 'second' END AS prompt, CAST(NULL AS VARCHAR) AS negative_prompt, 'm' AS model, 'a.safetensors: 0.5, style' || (o_custkey % 5) || '.safetensors' AS lora,
 CASE WHEN o_orderkey % 3 = 0 THEN '1.5' END AS hires_upscale, CASE WHEN o_orderkey % 3 = 1 THEN '4x' END AS hires_upscaler FROM orders""")
def graph_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of two passes."""
    return graph.records(X.view(spark, sf_dir, X.TWO_PASSES)).select("file_id", "seed", "steps", "sampler", "prompt", "negative_prompt", "model", "lora", "hires_upscale", "hires_upscaler")


#: Walks the graphs: parts of nodes by class, separators between them, leaves in the order of their paths.
WALKED = f"""WITH RECURSIVE chunks AS ({duck(X.TEXTS)}), nodes AS (SELECT file_id, n.key AS node, n.value ->> '$.class_type' AS class, n.value -> '$.inputs' AS ins FROM chunks, json_each(chunks.text) AS n),
 rule(class, input, ord) AS (VALUES ('CLIPTextEncode', 'text', 0), ('Reroute', 'source', 0), ('easy cleanGpuUsed', 'anything', 0), ('String Literal', 'string', 0), ('PrimitiveString', 'value', 0), ('StringConcatenate', 'string_a', 0), ('StringConcatenate', 'string_b', 2), ('JWStringConcat', 'a', 0), ('JWStringConcat', 'b', 2),
  ('Text Concatenate', 'text_a', 0), ('Text Concatenate', 'text_b', 2), ('Text Concatenate', 'text_d', 6), ('JoinStringMulti', 'string_1', 0), ('JoinStringMulti', 'string_2', 2)),
 held AS (SELECT file_id, node, r.ord, ins -> r.input AS v, ins ->> 'delimiter' AS sep FROM nodes JOIN rule r USING (class) WHERE (ins -> r.input) IS NOT NULL),
 parts AS (SELECT file_id, node, ord, CASE WHEN json_type(v) = 'ARRAY' THEN v ->> 0 END AS link, CASE WHEN json_type(v) <> 'ARRAY' THEN v ->> '$' END AS leaf FROM held UNION ALL
  SELECT file_id, node, ord - 1, NULL, coalesce(sep, '') FROM held WHERE ord > 0 UNION ALL SELECT file_id, node, 0, NULL, '[' || class || ']' FROM nodes WHERE class = 'TextGenerate'),
 walk(file_id, root, path, node, leaf) AS (SELECT file_id, node, '', node, CAST(NULL AS VARCHAR) FROM nodes WHERE node IN ('6', '7') UNION ALL SELECT w.file_id, w.root, w.path || p.ord, p.link, p.leaf FROM walk w JOIN parts p ON p.file_id = w.file_id AND p.node = w.node WHERE w.leaf IS NULL),
 said AS (SELECT file_id, root, string_agg(leaf, '' ORDER BY path) AS text, bool_or(leaf LIKE '[%') AS dead, bool_or(leaf NOT LIKE '[%' AND regexp_matches(leaf, '[a-z0-9]')) AS word FROM walk WHERE leaf IS NOT NULL GROUP BY ALL)
 SELECT p.file_id, CASE WHEN p.word THEN p.text END AS prompt, p.word AND p.dead AS partial, n.text AS negative_prompt FROM said p JOIN said n ON n.file_id = p.file_id AND n.root = '7' WHERE p.root = '6'"""


@register(WALKED)
def graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over several nodes; the SQL walks the graphs."""
    return graph.records(X.view(spark, sf_dir, X.TEXTS)).select("file_id", "prompt", "partial", "negative_prompt")


@register("""SELECT o_orderkey AS file_id, CASE o_orderkey % 8 WHEN 0 THEN 't' || o_custkey || ': 0.5, plain: 1' WHEN 1 THEN 'm' || o_custkey || ': 0.75, n: 1' WHEN 2 THEN 's' || o_custkey || ': 0.4' WHEN 3 THEN 'w' || o_custkey || ': 0.3' WHEN 4 THEN 'l' || o_custkey || '.safetensors'
 WHEN 5 THEN 'p' || o_custkey || ': 0.12' WHEN 6 THEN 'k' || o_custkey || ': 0.6, d: 1' ELSE 'f' || o_custkey || ': 1.5' END AS lora FROM orders""")
def graph_lora_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of its shapes."""
    return graph.records(X.view(spark, sf_dir, X.LORAS)).select("file_id", "lora")


@register("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN 'first ' || o_orderstatus || '; second ' || o_custkey WHEN 1 THEN 'promoted ' || o_custkey ELSE 'outer ' || o_orderstatus END END AS prompt,
 CASE WHEN o_orderkey % 4 = 0 THEN 'low' ELSE 'bad' END AS negative_prompt, o_orderkey AS seed, CAST(o_custkey % 40 + 1 AS INTEGER) AS steps, 7.5::DOUBLE AS cfg_scale, 'euler' AS sampler, 'normal' AS scheduler FROM orders""")
def canvas_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved canvases, with and without subgraphs."""
    return editor.records(X.view(spark, sf_dir, X.CANVASES)).select("file_id", "prompt", "negative_prompt", "seed", "steps", "cfg_scale", "sampler", "scheduler")


@register("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'own ' || o_orderkey ELSE 'a ' || o_orderstatus || ', ' || CASE WHEN o_orderkey % 4 = 0 THEN '[TextGenerate]' ELSE 'cust ' || o_custkey END END AS prompt,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 2 ELSE o_orderkey * 31 END AS seed, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || (o_orderkey % 5) || ': 0.5' END AS lora FROM orders""")
def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, M10."""
    return dispatch.image_info(X.view(spark, sf_dir, X.IMAGE_RECORDS)).select("file_id", "prompt", "seed", "lora")


@register(f"SELECT file_id, chunk_key, CASE WHEN file_id % 5 = 2 THEN 'too deep' ELSE 'unreadable' END AS reason FROM ({duck(X.REJECTS)}) WHERE file_id % 5 IN (1, 3) OR (file_id % 5 = 2 AND length(text) - length(replace(text, '[', '')) >= 200)")
def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6."""
    return json_records.rejects(X.view(spark, sf_dir, X.REJECTS))


@register(PARSED + "SELECT file_id, cfg_scale, steps FROM record ORDER BY cfg_scale DESC NULLS LAST, file_id LIMIT 50")
def files_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty files of the highest scale, a top-k report."""
    return dispatch.sorted_by(_records(spark, sf_dir), "cfg_scale", 50, descending=True).select("file_id", "cfg_scale", "steps")


CHUNK_SQL = f"""WITH c AS ({duck(X.CHUNKS)}), a AS (SELECT file_id, chunk_key, arg_max(text, ord) AS text FROM c GROUP BY ALL), t AS (SELECT file_id, chunk_key, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM a)
 SELECT file_id, chunk_key, row_number() OVER (PARTITION BY file_id ORDER BY chunk_key) AS cand_rank, CASE chunk_key WHEN 'prompt' THEN 0 WHEN 'workflow' THEN 1 ELSE 2 END AS graph_rank, chunk_key = 'xmp' AS is_xmp,
 starts_with(text, '{{') AND NOT regexp_matches(text, '(?m)^(Steps:|Negative prompt:)') AS is_graph_text, max(chunk_key IN ('prompt', 'workflow') OR contains(chunk_key, 'ComfyUI') OR (starts_with(text, '{{') AND (contains(text, 'class_type') OR contains(text, 'KSampler')))) OVER (PARTITION BY file_id) AS has_graph_chunk
 FROM t WHERE text <> ''"""


@register(CHUNK_SQL)
def chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18, C2, C3, C7-C9, C12."""
    return dispatch.candidates(X.view(spark, sf_dir, X.CHUNKS)).select("file_id", "chunk_key", F.col("cand_rank").cast("long").alias("cand_rank"), "graph_rank", "is_xmp", "is_graph_text", "has_graph_chunk")


@register()
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row a file, from all chunks."""
    return dispatch.image_info(X.view(spark, sf_dir, X.CHUNKS))


@register(rf"""WITH c AS ({duck(X.CHUNKS)}), k AS (SELECT file_id, max(chunk_key = 'parameters') AS has_block, max(chunk_key = 'prompt') AS has_graph, max(chunk_key = 'Comment') AS has_json, max(chunk_key = 'exif:UserComment') AS has_comment FROM c GROUP BY file_id),
 v AS (SELECT file_id * 10 AS file_id, CASE file_id % 7 WHEN 0 THEN 'ComfyUI' WHEN 1 THEN 'Forge' ELSE 'Automatic1111' END AS g FROM ({duck(X.BLOCKS)})), j AS (SELECT file_id * 10 + 1 AS file_id, CASE file_id % 3 WHEN 0 THEN 'InvokeAI' WHEN 1 THEN 'SwarmUI' ELSE 'NovelAI' END AS g FROM ({duck(X.JSONS)})),
 t AS (SELECT doc_id * 10 + 3 AS file_id, text FROM documents WHERE doc_id % 2 = 0 AND strlen(text) >= 15 AND NOT regexp_matches(text, '0x[0-9A-Fa-f]{{5}}') AND len(list_filter(regexp_split_to_array(text, '[ \t\r\n,]'), lambda w: w <> '')) >= 4 AND NOT regexp_matches(text, '^[{{\[]'))
 SELECT g AS generator, count(*) AS files FROM (SELECT g FROM v UNION ALL SELECT g FROM j UNION ALL SELECT 'ComfyUI' FROM k WHERE has_graph UNION ALL SELECT 'AI Image' FROM t) GROUP BY g""")
def generator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M7, M8."""
    return image_info(spark, sf_dir).groupBy("generator").agg(F.count("*").alias("files"))


MERGE_SQL = f"""WITH g AS (SELECT o.* FROM orders o) SELECT o_orderkey * 10 + 2 AS file_id, 'ComfyUI' AS generator, CASE WHEN o_orderkey % 20 = 0 THEN 'from a block' ELSE 'a ' || o_orderstatus || ', ' || CASE WHEN o_orderkey % 4 = 0 THEN '[TextGenerate]' ELSE 'cust ' || o_custkey END END AS prompt,
 'low ' || o_orderpriority AS negative_prompt, o_orderkey * 31 AS seed, 'euler' AS sampler, '512x768' AS size, CASE WHEN o_orderkey % 10 = 0 THEN 'v' || (o_orderkey % 3) END AS vae, '2:3' AS aspect_ratio, 0.39::DOUBLE AS megapixels FROM g"""


@register(MERGE_SQL)
def merged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph records whose gaps a parameter block fills; what the graph says stays, but for prompts with run-time markers."""
    return image_info(spark, sf_dir).filter("decoder_rank = 1").select("file_id", "generator", "prompt", "negative_prompt", "seed", "sampler", "size", "vae", "aspect_ratio", "megapixels")


@register(MERGE_SQL.replace("SELECT o_orderkey * 10 + 2 AS file_id", "SELECT file_id, prompt FROM (SELECT o_orderkey * 10 + 2 AS file_id") + ") WHERE contains(prompt, 'textgenerate') OR contains(lower(prompt), 'textgenerate')")
def search_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return dispatch.searched(image_info(spark, sf_dir), "TextGenerate", ("prompt",)).select("file_id", "prompt")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators_top(spark, sf_dir)
