"""JSON records, by a broadcast table of rules: a gate path and the paths of the fields. A new generator is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import spread

FIELDS = ["prompt", "negative_prompt", "model", "model_hash", "seed", "cfg_scale", "steps", "sampler", "scheduler", "clip_skip", "denoising_strength", "vae", "width", "height"]
#: Generator, rank, gate, excluded gate, then the path of each field; empty where a record has none.
RULES = [
    ("Draw Things", 2, "$.seed_mode", "", "$.c", "$.uc", "$.model", "", "$.seed", "$.scale", "$.steps", "$.sampler", "", "$.v2.clipSkip", "$.strength", "", "", ""),
    ("Easy Diffusion", 5, "$.use_stable_diffusion_model", "", "$.prompt", "$.negative_prompt", "$.use_stable_diffusion_model", "", "$.seed", "$.guidance_scale", "$.num_inference_steps", "$.sampler_name", "$.scheduler_name", "$.clip_skip", "$.prompt_strength", "$.use_vae_model", "$.width", "$.height"),
    ("WanGP", 6, "$.activated_loras", "", "$.prompt", "$.negative_prompt", "$.model_type", "", "$.seed", "$.guidance_scale", "$.num_inference_steps", "$.sample_solver", "", "", "$.denoising_strength", "", "", ""),
    ("InvokeAI", 7, "$.positive_prompt", "", "$.positive_prompt", "$.negative_prompt", "$.model.name", "$.model.hash", "$.seed", "$.cfg_scale", "$.steps", "$.scheduler", "", "$.clip_skip", "$.strength", "$.vae.name", "$.width", "$.height"),
    ("SwarmUI", 8, "$.cfgscale", "", "$.prompt", "$.negativeprompt", "$.model", "", "$.seed", "$.cfgscale", "$.steps", "$.sampler", "$.scheduler", "$.clipstopatlayer", "", "$.vae", "$.width", "$.height"),
    ("NovelAI", 9, "$.uc", "$.seed_mode", "$.prompt", "$.uc", "", "", "$.seed", "$.scale", "$.steps", "$.sampler", "$.noise_schedule", "", "$.strength", "", "$.width", "$.height"),
]


def rules(spark: SparkSession) -> DataFrame:
    paths = ", ".join(f"p_{f} string" for f in FIELDS)
    return spark.createDataFrame(RULES, f"decoder string, decoder_rank int, gate string, without string, {paths}")


def document(text: Column) -> Column:
    """The object from the first brace on, NaN and infinities outside strings as 0; null if it can't be read."""
    body = F.substr(text, F.locate("{", text), F.length(text))
    # strings and the words to replace each get a mark (a sign that no JSON holds raw); that after a string goes again
    marked = F.regexp_replace(body, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|-?\b(?:NaN|Infinity)\b', "$1\u0001")
    finite = F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit("0"))
    odd = F.contains(body, F.lit("NaN")) | F.contains(body, F.lit("Infinity"))
    return F.when(F.contains(text, F.lit("{")), F.try_parse_json(F.when(odd, finite).otherwise(body)))


def is_object(v: Column, path: str = "$") -> Column:
    """Whether a variant holds an object at path, without the schema of all that is in it."""
    return F.try_variant_get(v, F.lit(path), "struct<x: variant>").isNotNull()


def number(doc: Column, path: Column) -> Column:
    """A number, or a string that is wholly one."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    value = F.try_variant_get(doc, path, "string")
    numeric = kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")) | ((kind == "STRING") & value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"))
    return F.when(numeric, F.trim(value))


def candidates(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed objects (file_id, chunk_key, text, doc), and what looks like JSON but can't be read."""
    parsed = chunks.filter(F.contains("text", F.lit("{"))).withColumn("doc", document(F.col("text")))
    is_object = F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT"))
    return parsed.filter(is_object), parsed.filter(T.is_blob(F.col("text")) & ~F.coalesce(is_object, F.lit(False))).select("file_id", "chunk_key", F.lit("unreadable").alias("reason"))


DEEPEST = 200


def depth(text: Column) -> Column:
    """How deep brackets outside strings are nested."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step)["most"]


def rejects(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_key, reason) of chunks that look like JSON and give no record: nested deeper than DEEPEST, or unreadable."""
    brackets = F.length("text") - F.length(F.translate("text", "[{", ""))
    too_deep = F.when(brackets > DEEPEST, depth(F.col("text"))).otherwise(0) > DEEPEST
    is_object = F.coalesce(F.startswith(F.schema_of_variant(document(F.col("text"))), F.lit("OBJECT")), F.lit(False))
    reason = F.when(too_deep, "too deep").when(~is_object, "unreadable")
    return chunks.filter(T.is_blob(F.col("text"))).select("file_id", "chunk_key", reason.alias("reason")).filter("reason IS NOT NULL")


def records(chunks: DataFrame) -> DataFrame:
    """One record for each (chunk, rule) whose gate is open."""
    spark = chunks.sparkSession
    objects, _ = candidates(spread(chunks, "file_id"))
    inner = F.try_variant_get("doc", F.lit("$.sui_image_params"), "variant")
    objects = objects.withColumn("doc", F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("doc")))
    doc = F.col("doc")
    has = lambda path: F.try_variant_get(doc, path, "variant").isNotNull()
    paired = objects.crossJoin(F.broadcast(rules(spark)))  # RULES is fixed
    gated = paired.filter(has(F.col("gate")) | ((F.col("decoder") == "SwarmUI") & has(F.lit("$.negativeprompt")))).filter((F.col("without") == "") | ~has(F.col("without")))
    path = lambda f: F.when(F.col(f"p_{f}") != "", F.col(f"p_{f}")).otherwise(F.lit("$.\u0001"))
    text = lambda f: T.none_if_empty(F.try_variant_get(doc, path(f), "string"))
    w, h = (number(doc, path(f)).try_cast("int") for f in ("width", "height"))
    named = lambda p: F.try_variant_get(doc, F.lit(p), "array<variant>")
    string = lambda p: F.try_variant_get(doc, F.lit(p), "string")
    item = lambda x, p, t: F.try_variant_get(x, F.lit(p), t)
    is_text = lambda p: F.schema_of_variant(F.try_variant_get(doc, F.lit(p), "variant")) == "STRING"
    # a list is an array, or one string with commas
    listed = lambda p: F.transform(F.when(is_text(p), F.split(string(p), ",")).otherwise(F.transform(named(p), lambda x: x.cast("string"))), T.trim_blank)
    as_weight = lambda w: F.coalesce(T.compact_number(w.try_cast("double")), w)
    with_weight = lambda name, w: F.concat_ws(": ", name, T.none_if_empty(w))
    filled = lambda names: F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")
    base = lambda x: F.element_at(F.split(x, "/"), -1)
    multipliers = F.filter(F.split(string("$.loras_multipliers"), r"\s+"), lambda x: x != "")
    lora = (
        F.when(F.col("decoder") == "InvokeAI", F.transform(named("$.loras"), lambda x: F.concat_ws(": ", item(x, "$.model.name", "string"), T.compact_number(item(x, "$.weight", "double")))))
        .when(F.col("decoder") == "SwarmUI", filled(F.transform(listed("$.loras"), lambda x, i: F.when(x != "", with_weight(x, as_weight(F.get(listed("$.loraweights"), i)))))))
        .when(F.col("decoder") == "Draw Things", F.transform(named("$.lora"), lambda x: F.concat_ws(": ", item(x, "$.model", "string"), T.compact_number(item(x, "$.weight", "double")))))
        .when(F.col("decoder") == "WanGP", filled(F.transform(named("$.activated_loras"), lambda x, i: F.when((F.schema_of_variant(x) == "STRING") & (base(x.cast("string")) != ""), with_weight(base(x.cast("string")), F.get(multipliers, i))))))
        .when(F.col("decoder") == "Easy Diffusion", F.array(string("$.use_lora_model")))
    )
    model = F.coalesce(F.when(F.col("decoder") == "WanGP", T.none_if_empty(base(string("$.model_filename")))), text("model"))
    size = F.coalesce(T.size_string(w, h), F.when(F.col("decoder") == "Draw Things", string("$.size")), F.when(F.col("decoder") == "WanGP", T.none_if_empty(string("$.resolution"))))
    clip = number(doc, path("clip_skip")).try_cast("int")
    out = gated.withColumns({
        "generator": F.col("decoder"), "prompt": text("prompt"), "negative_prompt": text("negative_prompt"), "model": T.strip_model_ending(model), "model_hash": T.real_hash(F.regexp_replace(text("model_hash"), "^blake3:", "")),
        "seed": number(doc, path("seed")).try_cast("bigint"), "cfg_scale": number(doc, path("cfg_scale")).try_cast("double"), "steps": number(doc, path("steps")).try_cast("int"),
        "sampler": text("sampler"), "scheduler": text("scheduler"), "clip_skip": F.when(F.col("decoder") == "SwarmUI", F.abs(clip)).otherwise(clip), "size": size,
        "denoising_strength": number(doc, path("denoising_strength")).try_cast("double"), "vae": T.strip_model_ending(text("vae")), "lora": T.none_if_empty(F.array_join(lora, ", ")), "full_parameters": T.trim_blank(F.col("text")),
    })
    return out.drop("doc", "gate", "without", "decoder", *(f"p_{f}" for f in FIELDS))
