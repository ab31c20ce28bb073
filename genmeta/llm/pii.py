"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for bank account numbers, value ranges for
addresses, digit counts for phones), and words near a span raise or lower its score. Base kinds keep every confirmed span,
whatever its score; added kinds (iban, short_card, ssn) need a score of KEEP.

Everything is computed within a row, without a shuffle: split() gives the text between matches, so lengths of pieces and
matches give the positions. Patterns use possessive loops, which match the same spans as greedy ones here (what follows a
loop never needs a character back) but neither recurse nor retry on long runs. A match may start only at the start of a run
or where the last match ended, since a later start in a run fails where the first did.

Nulls: a null text is empty and has no span. Extra columns are ignored. Rows that share an id stay rows of their own. An empty
table gives no rows. Very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KEEP = 0.6
NEAR = 48
BLOCK = 256

#: Patterns. The first four are the base kinds, in their order.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9-])[0-9](?:[\x20-]?+[0-9])++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A string that any text with a match must contain, as a pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "short_card": r"[0-9][\x20-]?[0-9]", "ssn": r"[0-9]-[0-9]"}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span without context, and words that raise it (+0.25) or lower it (-0.25).
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.4, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|telefono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "short_card": "card|visa|amex|master|credit|debit|payment|karte|carte|tarjeta",
    "ssn": "ssn|social|security",
}
LOWER = {
    "email": "example|noreply",
    "ip": "version|release|build",
    "card": "order|isbn|serial|tracking",
    "phone": "order|isbn|serial|version",
    "iban": "serial|part",
    "short_card": "order|isbn|serial|tracking|version",
    "ssn": "order|isbn|serial|part",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """The remainder that makes an account number valid when it is 1: country and check digits last, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(step(rest, char)))


def confirmed(kind: str, match: Column) -> Column:
    own = digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))
    if kind == "card":
        return F.length(own).between(16, 19) & F.call_function("luhn_check", own)
    if kind == "short_card":
        return F.length(own).between(13, 15) & F.call_function("luhn_check", own)
    if kind == "phone":
        return F.length(own).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(match) == 1)
    return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")


def before(lengths: Column) -> Column:
    """For each element the sum of those before it; sums of blocks keep the work near linear in long arrays."""
    plus = lambda a, x: a + x
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), plus)
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    starts = let(blocks, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))
    return let(starts, lambda s: F.transform(lengths, lambda _, i: F.get(s, F.floor(i / BLOCK).cast("int")) + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>>: confirmed spans of one kind, by start; code points, end exclusive."""
    pattern = F.lit(PATTERNS[kind])

    def located(matches: Column, pieces: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        near = lambda i: F.lower(F.concat(F.right(F.get(pieces, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(NEAR))))

        def span(match: Column, i: Column, starts: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(pieces, i))
            said = near(i)
            score = F.lit(START[kind]) + F.when(said.rlike(rf"\b(?:{RAISE[kind]})"), 0.25).otherwise(0.0) - F.when(said.rlike(rf"\b(?:{LOWER[kind]})"), 0.25).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(match)).cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"), confirmed(kind, match).alias("ok"))

        found = let(before(steps), lambda starts: F.transform(matches, lambda m, i: span(m, i, starts)))
        good = F.filter(found, lambda s: s["ok"] if kind in BASE else s["ok"] & (s["score"] >= KEEP))
        return F.transform(good, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))

    all_matches = F.regexp_extract_all(text, pattern, F.lit(0))
    some = let(all_matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, PATTERNS[kind], -1), lambda p: located(m, p))))
    return F.coalesce(F.when(text.rlike(HINTS[kind]), some), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>), kinds in their order, then by start."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    parts = rows.select("doc_id", *(spans_of(kind, F.col("text")).alias(kind) for kind in PATTERNS))
    base = F.concat(*(F.col(kind) for kind in PATTERNS))
    return parts.select("doc_id", base.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of base kinds, a digest of base spans, all spans, and the mean score."""
    found = find(docs, id_col=id_col, text_col=text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span that find() keeps, of all kinds, replaced by <KIND>. Spans that overlap are one, marked by the kind of the first, the longest of those that start together. A null text stays null."""
    text = F.col(text_col)
    spans = F.concat(*(spans_of(kind, text) for kind in PATTERNS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("less"), s["kind"])))
    state = "struct<parts:array<string>,at:bigint>"

    def step(done: Column, s: Column) -> Column:
        parts, at, end = done["parts"], done["at"], -s["less"]
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        cut = F.concat(parts, F.array(F.substr(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), mark))
        return F.struct(F.when(s["start"] >= at, cut).otherwise(parts).alias("parts"), F.greatest(at, end).alias("at")).cast(state)

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at")).cast(state)
    finish = lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))
    clean = let(ordered, lambda found: F.when(F.size(found) > 0, F.aggregate(found, start, step, finish)).otherwise(text))
    return docs.withColumn(text_col, clean)
