"""Column builders for strings of generation metadata. All are native expressions; nulls stay null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BLANKS = " \t\r\n\0"
SCHEDULERS = ["simple", "normal", "karras", "exponential", "sgd_uniform", "ddim_uniform", "beta", "linear_quadratic", "kl_optimal"]
MODEL_ENDINGS = ["safetensors", "ckpt", "pt", "pth", "bin", "gguf"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_blank(text: Column) -> Column:
    """Without blanks, tabs, line ends and NUL at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def looks_generated(text: Column) -> Column:
    """Free text that may come from an image generator."""
    words = F.filter(F.split(text, "[ \t\r\n,\\x00]"), lambda w: w != "")
    return (
        (F.octet_length(text) >= 15) & ~text.rlike("0x[0-9A-Fa-f]{5}") & ~text.rlike(r"^[{\[]") & ~text.startswith("CREATOR:") & ~text.startswith("File written by")
        & ~text.startswith("Generated by") & ~text.contains("JPEG Library") & (F.size(words) >= 4)
    )


def is_blob(text: Column) -> Column:
    """C11: serialised data, not prose."""
    return text.rlike(r"^[ \t\r\n]*[{\[]")


def contains_ci(text: Column, part: str) -> Column:
    """C13."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def parse_seed(text: Column) -> Column:
    """Sign and leading digits; null outside 64 bits."""
    return F.regexp_extract(text, r"^[ \t]*([+-]?[0-9]+)", 1).try_cast("bigint")


def leading_int(text: Column) -> Column:
    """A10: leading digits, 0 if there are none, bounded to 32 bits."""
    digits = F.regexp_extract(text, r"^[ \t]*([+-]?[0-9]+)", 1)
    value = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return F.when(text.isNotNull(), F.least(F.greatest(value, F.lit(-2147483648).cast("decimal(38,0)")), F.lit(2147483647).cast("decimal(38,0)")).cast("int"))


def leading_double(text: Column) -> Column:
    """A10: the number that a text begins with, its exponent too; 0 if there is none."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^[ \t\r\n]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0)))


def real_hash(text: Column) -> Column:
    """Null for the hash of nothing."""
    return F.when(~((F.length(text) >= 8) & F.startswith(F.lit(EMPTY_SHA256), F.lower(text))), text)


def strip_model_ending(text: Column) -> Column:
    """M9."""
    return F.regexp_replace(text, rf"(?i)^(.+)\.({'|'.join(MODEL_ENDINGS)})$", "$1")


#: Endings of model files in graphs.
GRAPH_MODEL_ENDINGS = [*MODEL_ENDINGS, "sft"]


def is_model_file(text: Column) -> Column:
    """A name with the ending of a model file."""
    return text.rlike(rf"(?i)\.({'|'.join(GRAPH_MODEL_ENDINGS)})$")


def strip_any_model_ending(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)\.({'|'.join(GRAPH_MODEL_ENDINGS)})$", "")


def normalise_loras(text: Column) -> Column:
    """Names of a comma list without quotes and endings."""
    item = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), rf"(?i)^(.+?)\.({'|'.join(MODEL_ENDINGS)})(: .*)?$", "$1$3")
    return none_if_empty(F.array_join(F.filter(F.transform(F.split(text, ","), item), lambda x: x != ""), ", "))


def sides(size: Column) -> tuple[Column, Column]:
    """Both sides of WxH, null unless both are positive 32-bit numbers."""
    w, h = (F.regexp_extract(size, "^([0-9]+)x([0-9]+)$", k).try_cast("int") for k in (1, 2))
    ok = (w > 0) & (h > 0)
    return F.when(ok, w), F.when(ok, h)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 32-bit numbers need at most 46."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))))
    return state["a"]


def aspect_ratio(w: Column, h: Column) -> Column:
    """D2."""
    return let(gcd(w, h), lambda g: F.concat((w / g).cast("int").cast("string"), F.lit(":"), (h / g).cast("int").cast("string")))


def megapixels(w: Column, h: Column) -> Column:
    """D3."""
    return F.round(w.cast("double") * h.cast("double") / 1e6 * 100) / 100


def lora_count(text: Column) -> Column:
    """D4."""
    return F.when(none_if_empty(text).isNotNull(), F.size(F.split(text, ",")))


def size_string(w: Column, h: Column) -> Column:
    """J3."""
    return F.when((w > 0) & (h > 0), F.concat_ws("x", w.cast("string"), h.cast("string")))


def compact_number(x: Column) -> Column:
    """At most two places, ties to even."""
    return F.call_function("format_number", x, F.lit("0.##"))


def formula_size(ratio_w: Column, ratio_h: Column, mega: Column, multiple: int) -> Column:
    """A size of about mega million pixels with the given ratio, sides in multiples, ties to even."""
    scale = F.sqrt(mega * 1024.0 * 1024.0 / (ratio_w * ratio_h))
    side = lambda r: (F.rint(r * scale / multiple) * multiple).cast("int")
    return F.concat_ws("x", side(ratio_w).cast("string"), side(ratio_h).cast("string"))


def unescape_xml(text: Column) -> Column:
    """The ampersand last, so that one pass is enough."""
    for code, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "\n"), ("&#13;", "\r"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def first_tag(text: Column, tag: str) -> Column:
    """What stands in the first <tag>...</tag>, literally; null without both."""
    start = F.locate(f"<{tag}>", text)
    rest = F.substr(text, start + len(tag) + 2, F.length(text))
    end = F.locate(f"</{tag}>", rest)
    return F.when((start > 0) & (end > 0), F.substr(rest, F.lit(1), end - 1))


def first_list_item(text: Column) -> Column:
    """The text of the first rdf:li, or the input."""
    start = F.locate("<rdf:li", text)
    rest = F.substr(text, start, F.length(text))
    body = F.substr(rest, F.locate(">", rest) + 1, F.length(rest))
    end = F.locate("</rdf:li>", body)
    return F.when((start > 0) & (F.locate(">", rest) > 0) & (end > 0), F.substr(body, F.lit(1), end - 1)).otherwise(text)


def decode_text(data: Column) -> Column:
    """UTF-8 if it is valid, else Latin-1."""
    as_text = data.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(data, "ISO-8859-1"))
