"""Inputs derived from the driver's tables by SQL that Spark and DuckDB run unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

BLOCKS = """
SELECT p_partkey AS file_id, 'parameters' AS chunk_key,
 concat('photo of ', p_name, ', ', lower(p_type), ' style <lora:', replace(p_name,' ','_'), ':0.', CAST(p_partkey % 9 + 1 AS STRING), '5>',
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(chr(10), 'Negative prompt: blurry, ', p_brand) END,
  chr(10), 'Steps: ', CAST(p_size AS STRING),
  ', Sampler: ', CASE p_partkey % 3 WHEN 0 THEN 'Euler a' WHEN 1 THEN 'DPM++ 2M Karras' ELSE 'Euler simple' END,
  ', CFG scale: ', CAST(p_partkey % 15 + 1 AS STRING), '.5, Seed: ', CAST(p_partkey * 7919 + 1 AS STRING),
  ', Size: ', CAST(512 + 64 * (p_partkey % 5) AS STRING), 'x', CAST(512 + 64 * (p_size % 7) AS STRING),
  ', Model: ', replace(p_brand, '#', '_'), '.safetensors, Lora hashes: "', replace(p_name,' ','_'), ': ab12, extra: cd34"',
  CASE p_partkey % 7 WHEN 0 THEN ', Version: ComfyUI' WHEN 1 THEN ', Version: f2.0.1' ELSE ', Version: v1.9.4' END) AS text
FROM part
"""

JSONS = """
SELECT p_partkey AS file_id, 'Comment' AS chunk_key, CASE p_partkey % 3
 WHEN 0 THEN concat('{"positive_prompt":"', p_name, '","negative_prompt":"bad","model":{"name":"', p_brand, '","hash":"blake3:ff', CAST(p_size AS STRING), '"},"seed":', CAST(p_partkey AS STRING), ',"steps":"', CAST(p_size AS STRING), '","cfg_scale":7.5,"width":512,"height":768,"loras":[{"model":{"name":"x"},"weight":0.125}]}')
 WHEN 1 THEN concat('{"sui_image_params":{"prompt":"', p_name, '","cfgscale":6,"steps":', CAST(p_size AS STRING), ',"seed":18446744073709551615,"loras":["a","b"],"loraweights":["0.5","1.0"],"clipstopatlayer":-2}}')
 ELSE concat('{"prompt":"', p_name, '","uc":"bad","scale":5,"steps":null,"seed":"', CAST(p_partkey AS STRING), '","width":0,"height":768}') END AS text
FROM part
"""

GRAPHS = """
SELECT o_orderkey AS file_id, 'prompt' AS chunk_key, concat(
 '{"3":{"class_type":"KSampler","inputs":{"seed":', CAST(o_orderkey * 31 AS STRING), ',"steps":', CAST(o_custkey % 40 + 1 AS STRING), ',"cfg":7.5,"sampler_name":"euler","scheduler":"normal","denoise":1,"model":["4",0],"positive":["6",0],"negative":["7",0],"latent_image":["5",0]}},',
 '"4":{"class_type":"CheckpointLoaderSimple","inputs":{"ckpt_name":"m', CAST(o_custkey % 10 AS STRING), '.safetensors"}},',
 '"5":{"class_type":"EmptyLatentImage","inputs":{"width":512,"height":768}},',
 '"6":{"class_type":"CLIPTextEncode","inputs":{"text":["10",0]}},',
 '"7":{"class_type":"CLIPTextEncode","inputs":{"text":"low ', o_orderpriority, '"}},',
 '"10":{"class_type":"StringConcatenate","inputs":{"string_a":"a ', o_orderstatus, '","string_b":["11",0],"delimiter":", "}},',
 '"11":{"class_type":"', CASE WHEN o_orderkey % 4 = 0 THEN 'TextGenerate' ELSE 'Reroute' END, '","inputs":{', CASE WHEN o_orderkey % 4 = 0 THEN '"model":1' ELSE '"source":["12",0]' END, '}},',
 '"12":{"class_type":"String Literal","inputs":{"string":"cust ', CAST(o_custkey AS STRING), '"}},',
 '"8":{"class_type":"VAEDecode","inputs":{"samples":["3",0],"vae":["4",2]}},"9":{"class_type":"SaveImage","inputs":{"images":["8",0]}},',
 '"20":{"class_type":"CLIPTextEncode","inputs":{"text":"left over"}}}') AS text
FROM orders
"""

#: Two passes: chained by latents, by pixels, and by pixels with a prompt of its own.
TWO_PASSES = """
SELECT o_orderkey AS file_id, 'prompt' AS chunk_key, concat(
 '{"1":{"class_type":"CheckpointLoaderSimple","inputs":{"ckpt_name":"m.safetensors"}},"2":{"class_type":"LoraLoader","inputs":{"lora_name":"style', CAST(o_custkey % 5 AS STRING), '.safetensors","model":["13",0]}},',
 '"13":{"class_type":"Power Lora Loader (rgthree)","inputs":{"model":["1",0],"lora_1":{"on":true,"lora":"a.safetensors","strength":0.5},"lora_2":{"on":false,"lora":"b.safetensors","strength":1}}},',
 '"3":{"class_type":"KSampler","inputs":{"seed":["20",0],"steps":20,"cfg":7,"sampler_name":"euler","scheduler":"normal","denoise":1,"model":["2",0],"positive":["6",0],"negative":["7",0],"latent_image":["5",0]}},',
 '"20":{"class_type":"Seed Everywhere","inputs":{"increment":1,"seed":', CAST(o_orderkey AS STRING), '}},"5":{"class_type":"EmptyLatentImage","inputs":{"width":512,"height":768}},"6":{"class_type":"CLIPTextEncode","inputs":{"text":["10",0]}},',
 '"10":{"class_type":"ComfySwitchNode","inputs":{"switch":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"on_true":["11",0],"on_false":["12",0]}},"11":{"class_type":"String Literal","inputs":{"string":"first ', CAST(o_custkey AS STRING), '"}},',
 '"12":{"class_type":"String Literal","inputs":{"string":"', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'second' END, '"}},"7":{"class_type":"ConditioningZeroOut","inputs":{"conditioning":["6",0]}},"8":{"class_type":"VAEDecode","inputs":{"samples":["3",0]}},',
 CASE WHEN o_orderkey % 3 = 0 THEN '"14":{"class_type":"LatentUpscaleBy","inputs":{"samples":["3",0],"scale_by":1.5}},' ELSE '"14":{"class_type":"ImageUpscaleWithModel","inputs":{"upscale_model":["17",0],"image":["8",0]}},"17":{"class_type":"UpscaleModelLoader","inputs":{"model_name":"4x.pth"}},"18":{"class_type":"VAEEncode","inputs":{"pixels":["14",0]}},' END,
 '"15":{"class_type":"KSampler","inputs":{"seed":', CAST(o_orderkey + 7 AS STRING), ',"steps":9,"cfg":3,"sampler_name":"heun","scheduler":"karras","model":["2",0],"negative":["7",0],', CASE o_orderkey % 3 WHEN 0 THEN '"denoise":0.4,"positive":["6",0],"latent_image":["14",0]' WHEN 1 THEN '"positive":["6",0],"latent_image":["18",0]' ELSE '"positive":["19",0],"latent_image":["18",0]' END, '}},',
 '"19":{"class_type":"CLIPTextEncode","inputs":{"text":"own ', CAST(o_orderkey AS STRING), '"}},"16":{"class_type":"VAEDecode","inputs":{"samples":["15",0]}},"9":{"class_type":"SaveImage","inputs":{"images":["16",0]}}}') AS text
FROM orders
"""

FILES = """
SELECT event_id, concat('img/', CAST(user_id AS STRING), '/', CAST(event_id % 20 AS STRING), CASE event_id % 3 WHEN 0 THEN '.PNG' ELSE '.png' END) AS path,
 ts AS modification_time, (event_id * 37) % 5000 AS length FROM events
"""

EDGES = """
SELECT DISTINCT a.l_orderkey AS file_id, CAST(a.l_linenumber AS STRING) AS dst, CAST(b.l_linenumber AS STRING) AS src FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND (b.l_linenumber = a.l_linenumber - 1 OR b.l_linenumber * 2 = a.l_linenumber OR (a.l_linenumber = 1 AND b.l_linenumber = 4))
"""

PACKETS = """
SELECT p_partkey AS file_id, concat('<x:xmpmeta><dc:description><rdf:Alt><rdf:li xml:lang="x-default">', p_name, ' &amp;lt; &quot;', p_brand, '&quot;&#10;Steps: 20</rdf:li></rdf:Alt></dc:description><exif:UserComment>', p_type, '</exif:UserComment></x:xmpmeta>') AS packet FROM part
"""

CHUNKS = f"""
SELECT file_id * 10 AS file_id, 0 AS ord, chunk_key, text FROM ({BLOCKS})
UNION ALL SELECT file_id * 10 AS file_id, 1 AS ord, 'xmp' AS chunk_key, concat('<x>', CAST(file_id AS STRING), '</x>') AS text FROM ({BLOCKS}) WHERE file_id % 4 = 0
UNION ALL SELECT file_id * 10 AS file_id, -1 AS ord, chunk_key, 'Steps: 1 older text' AS text FROM ({BLOCKS}) WHERE file_id % 6 = 0
UNION ALL SELECT file_id * 10 + 1 AS file_id, 0 AS ord, chunk_key, text FROM ({JSONS})
UNION ALL SELECT file_id * 10 + 2 AS file_id, 0 AS ord, chunk_key, text FROM ({GRAPHS})
UNION ALL SELECT file_id * 10 + 2 AS file_id, 1 AS ord, 'parameters' AS chunk_key, concat('from a block', chr(10), 'Negative prompt: worse', chr(10), 'Steps: 9, Sampler: Heun, CFG scale: 3, Seed: 5, Size: 640x640, VAE: v', CAST(file_id % 3 AS STRING)) AS text FROM ({GRAPHS}) WHERE file_id % 10 = 0
UNION ALL SELECT doc_id * 10 + 3 AS file_id, 0 AS ord, CASE WHEN doc_id % 2 = 0 THEN 'exif:UserComment' ELSE 'xmp:dc:description' END AS chunk_key, text FROM documents
"""


#: Texts over several nodes: joins in joins, passes, and parts that are only known at run time.
TEXTS = """
SELECT o_orderkey AS file_id, 'prompt' AS chunk_key, concat(
 '{"3":{"class_type":"KSampler","inputs":{"seed":1,"model":["4",0],"positive":["6",0],"negative":["7",0],"latent_image":["5",0]}},"4":{"class_type":"UNETLoader","inputs":{"unet_name":"u.safetensors"}},"5":{"class_type":"EmptyLatentImage","inputs":{"width":512,"height":512}},',
 '"6":{"class_type":"CLIPTextEncode","inputs":{"text":["10",0]}},"7":{"class_type":"CLIPTextEncode","inputs":{"text":"low ', CAST(o_custkey AS STRING), '"}},"9":{"class_type":"SaveImage","inputs":{"images":["3",0]}},',
 CASE o_orderkey % 3 WHEN 0 THEN concat('"10":{"class_type":"StringConcatenate","inputs":{"string_a":"a ', o_orderstatus, '","string_b":["11",0],"delimiter":", "}},') WHEN 1 THEN '"10":{"class_type":"Text Concatenate","inputs":{"text_a":["12",0],"text_b":["11",0],"text_d":["12",0],"delimiter":" / "}},' ELSE '"10":{"class_type":"Reroute","inputs":{"source":["11",0]}},' END,
 CASE o_custkey % 5 WHEN 0 THEN '"11":{"class_type":"Reroute","inputs":{"source":["13",0]}},' WHEN 1 THEN '"11":{"class_type":"JWStringConcat","inputs":{"a":["13",0],"b":" tail"}},' WHEN 2 THEN '"11":{"class_type":"TextGenerate","inputs":{}},'
  WHEN 3 THEN '"11":{"class_type":"JoinStringMulti","inputs":{"inputcount":2,"string_1":["13",0],"string_2":"x","delimiter":" - "}},' ELSE '"11":{"class_type":"StringConcatenate","inputs":{"string_a":["14",0],"string_b":["13",0],"delimiter":"; "}},' END,
 '"14":{"class_type":"easy cleanGpuUsed","inputs":{"anything":["15",0]}},"15":{"class_type":"Text Concatenate","inputs":{"text_a":"deep ', CAST(o_custkey % 7 AS STRING), '","text_b":["12",0],"delimiter":" "}},',
 '"12":{"class_type":"String Literal","inputs":{"string":"lit ', CAST(o_custkey AS STRING), '"}},"13":{"class_type":"PrimitiveString","inputs":{"value":"cust ', CAST(o_orderkey AS STRING), '"}}}') AS text
FROM orders
"""

#: Saved canvases: without a subgraph, and with one whose promoted widgets are free, wired from a literal, or wired from elsewhere.
CANVASES = """
SELECT o_orderkey AS file_id, 'workflow' AS chunk_key, CASE WHEN o_orderkey % 4 = 0 THEN concat(
 '{"nodes":[{"id":3,"type":"KSampler","inputs":[{"name":"positive","link":1},{"name":"negative","link":2}],"widgets_values":[', CAST(o_orderkey AS STRING), ',"fixed",', CAST(o_custkey % 40 + 1 AS STRING), ',7.5,"euler","normal",1]},{"id":6,"type":"CLIPTextEncode","inputs":[{"name":"text","link":3,"widget":{}}],"widgets_values":["stale"]},',
 '{"id":7,"type":"CLIPTextEncode","inputs":[],"widgets_values":["low"]},{"id":8,"type":"Text Concatenate","inputs":[{"name":"text_a","link":4},{"name":"text_b","link":5}],"widgets_values":["; "]},{"id":9,"type":"PrimitiveString","inputs":[],"widgets_values":["first ', o_orderstatus, '"]},{"id":10,"type":"Reroute","inputs":[{"name":"","link":6}]},',
 '{"id":11,"type":"PrimitiveStringMultiline","inputs":[],"widgets_values":["second ', CAST(o_custkey AS STRING), '"]},{"id":12,"type":"KSampler","mode":4,"inputs":[],"widgets_values":[1,"fixed",1,1,"no","no",1]}],"links":[[1,6,0,3,0,"C"],[2,7,0,3,1,"C"],[3,8,0,6,0,"S"],[4,9,0,8,0,"S"],[5,10,0,8,1,"S"],[6,11,0,10,0,"S"]]}')
 ELSE concat('{"nodes":[{"id":1,"type":"sg","inputs":[{"name":"image"},{"name":"words","widget":{}', CASE o_orderkey % 4 WHEN 1 THEN '' ELSE ',"link":4' END, '}],"widgets_values":["promoted ', CAST(o_custkey AS STRING), '",', CAST(o_orderkey AS STRING), ']},{"id":2,"type":"', CASE o_orderkey % 4 WHEN 2 THEN 'PrimitiveString' ELSE 'Generator' END, '","inputs":[],"widgets_values":["outer ', o_orderstatus, '"]}],"links":[[4,2,0,1,1,"S"]],',
 '"definitions":{"subgraphs":[{"id":"sg","inputNode":{"id":-10},"inputs":[{"name":"image"},{"name":"words"},{"name":"seed"}],"nodes":[{"id":1,"type":"CLIPTextEncode","inputs":[{"name":"text","link":5,"widget":{}}],"widgets_values":["frozen"]},{"id":2,"type":"CLIPTextEncode","inputs":[],"widgets_values":["bad"]},',
 '{"id":3,"type":"KSampler","inputs":[{"name":"positive","link":6},{"name":"negative","link":7},{"name":"latent","link":8},{"name":"seed","link":9,"widget":{}}],"widgets_values":[1,"fixed",', CAST(o_custkey % 40 + 1 AS STRING), ',7.5,"euler","normal",1]}],"links":[{"id":5,"origin_id":-10,"origin_slot":1,"target_id":1,"target_slot":0},{"id":6,"origin_id":1,"origin_slot":0,"target_id":3,"target_slot":0},',
 '{"id":7,"origin_id":2,"origin_slot":0,"target_id":3,"target_slot":1},{"id":8,"origin_id":-10,"origin_slot":0,"target_id":3,"target_slot":2},{"id":9,"origin_id":-10,"origin_slot":2,"target_id":3,"target_slot":3}]}]}}') END AS text
FROM orders
"""

#: LoRAs in each of the ways in which nodes hold them, by order.
LORAS = """
SELECT o_orderkey AS file_id, 'prompt' AS chunk_key, concat('{"3":{"class_type":"KSampler","inputs":{"seed":1,"positive":["6",0],"negative":["6",0],"model":["2",0]}},"6":{"class_type":"CLIPTextEncode","inputs":{"text":"a"}},"9":{"class_type":"SaveImage","inputs":{"images":["3",0]}},"2":{"class_type":"',
 CASE o_orderkey % 8 WHEN 0 THEN concat('LoraTagLoader","inputs":{"text":["4",0]}},"4":{"class_type":"String Literal","inputs":{"string":"<lora:t', CAST(o_custkey AS STRING), ':0.50> and <lora:plain> <LORA:no:1>"}}}')
 WHEN 1 THEN concat('Lora Loader (LoraManager)","inputs":{"text":"<lora:no:1>","loras":{"__value__":[{"name":"m', CAST(o_custkey AS STRING), '","strength":"0.75","active":true},{"name":"off","strength":1,"active":false},{"name":"n","active":true}]}}}}')
 WHEN 2 THEN concat('PromptToolkit_SuperEncode","inputs":{"lora_1":"s', CAST(o_custkey AS STRING), '","strength_1":"0.4","use_lora_2":"false","lora_2":"off","lora_3":"None"}}}')
 WHEN 3 THEN concat('WeiLinPromptUI","inputs":{"lora_str":"[{', chr(92), '"name', chr(92), '":', chr(92), '"w', CAST(o_custkey AS STRING), chr(92), '",', chr(92), '"weight', chr(92), '":0.3},{', chr(92), '"name', chr(92), '":', chr(92), '"off', chr(92), '",', chr(92), '"hidden', chr(92), '":true}]"}}}')
 WHEN 4 THEN concat('LoraLoader","inputs":{"lora_name":"l', CAST(o_custkey AS STRING), '.safetensors"}}}') WHEN 5 THEN concat('Power Lora Loader (rgthree)","inputs":{"lora_1":{"on":true,"lora":"p', CAST(o_custkey AS STRING), '","strength":0.125},"lora_2":{"on":false,"lora":"off","strength":1}}}}')
 WHEN 6 THEN concat('LoRA Stacker","inputs":{"lora_name_1":"k', CAST(o_custkey AS STRING), '","lora_wt_1":0.6,"lora_name_2":"None","lora_name_3":"d"}}}') ELSE concat('Multi Lora Loader","inputs":{"lora_01":"f', CAST(o_custkey AS STRING), '","strength_01":1.5,"lora_02":"None"}}}') END) AS text
FROM orders
"""

#: Graphs with a record of the one image, blocks, and texts that look like JSON but can't be read.
IMAGE_RECORDS = f"""
SELECT file_id, 0 AS ord, chunk_key, text FROM ({GRAPHS})
UNION ALL SELECT file_id, 1 AS ord, 'anima_image_seed_v1' AS chunk_key, concat('{{"positive":"', CASE file_id % 3 WHEN 0 THEN '' ELSE concat('own ', CAST(file_id AS STRING)) END, '","seed":', CAST(file_id * 2 AS STRING), ',"prompt_loras":[["dir/x', CAST(file_id % 5 AS STRING), '.safetensors",0.5],["broken"]]}}') AS text FROM ({GRAPHS}) WHERE file_id % 2 = 0
"""

REJECTS = """
SELECT o_orderkey AS file_id, 0 AS ord, 'Comment' AS chunk_key, CASE o_orderkey % 5 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '{"a": ' WHEN 2 THEN concat('{"a":', repeat('[', CAST(150 + o_custkey % 100 AS INT)), repeat(']', CAST(150 + o_custkey % 100 AS INT)), '}') WHEN 3 THEN '[not json' ELSE concat('words ', o_orderstatus) END AS text FROM orders
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a recipe over the tables in sf_dir, each read by its path."""
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))
