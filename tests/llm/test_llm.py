"""The corpus operators against brute force, round trips and held-out rows; nulls, empty and repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from genmeta.llm import graph, ann, byte_bpe, decontaminate, language, license_scan, lm_score, near_dup, pii, queries, token_store, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string"
WORDS = "amber basin cedar delta ember fjord grove harbor island jungle kernel lagoon meadow nectar orchid prairie quartz ridge summit tundra".split()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [(1, None), (2, ""), (3, "  \n"), (4, "same text here"), (4, "same text here"), (None, "no id"), (7, "x" * 50_000), (8, "+1 (415) 555-0100 a@b.co 4111111111111111 " * 200)])


def test_codes_round_trip_and_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0]), np.array([255, 256, 65536]), rng.integers(0, 1 << 20, 3000) >> rng.integers(0, 20, 3000)):
        code = token_store.Code(token_store.pack(ids))
        assert code.all().tolist() == list(ids)
        assert [code[i] for i in range(len(ids))] == list(ids)


def test_token_store(spark, odd):
    path = token_store.write_store(odd, queries.WORD_TOKENIZER, 2, shards=3)
    rows = sorted(token_store.document_digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == 8 and rows[0]["doc_id"] is None
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    tokenizer = __import__("tokenizers").Tokenizer.from_file(queries.WORD_TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4").tobytes())
    ids = {r["doc_id"]: (r["start"], r["ids"]) for r in token_store.read_documents(spark, path).collect()}
    empty = token_store.write_store(odd.limit(0), queries.WORD_TOKENIZER, 2)
    assert token_store.document_digests(spark, empty).count() == 0
    start, own = ids[8]
    got = token_store.tokens_at(spark, path, spark.createDataFrame([(start,), (start + 5,), (-1,), (10**12,), (None,)], "position long")).collect()
    assert sorted((r["position"], r["id"]) for r in got) == [(start, own[0]), (start + 5, own[5])]


@pytest.mark.parametrize("leaf,long_match", [(1, 2), (3, 4), (7, 5), (50, 20)])
def test_tree_encoding_is_exact(leaf, long_match):
    bpe = byte_bpe.TreeBpe(queries.BYTE_RANKS, public_tokenizers.PATTERN, leaf, long_match)
    rng = random.Random(leaf)
    for _ in range(150):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "'", "'ll", "é", "12", "!", "　", "\x1c", "ab" * 9, "😀"]) for _ in range(rng.randint(0, 40)))
        ids = bpe.encode(text)
        assert ids == bpe.core.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_rows(spark, odd):
    encoded = byte_bpe.encode(odd, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    back = sorted(bytes(r["data"]) for r in byte_bpe.decode(encoded, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((r["text"] or "").encode() for r in odd.collect())


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(x):
    plain = lambda a: re.sub("[^0-9]", "", a)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda a: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda a: all(int(q) <= 255 for q in a.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda a: 16 <= len(plain(a)) <= 19 and luhn(plain(a))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda a: 8 <= len(plain(a)) <= 15),
    )
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, x) if ok(m.group()))


def test_pii(spark, odd):
    rng = random.Random(5)
    parts = ["a", "@", ".", "b-c", "1", "22", "255", "256", " ", "-", "+", "4111 1111 1111 1111", "(", "é😀", "_", "x@y.z", "00012", "+1 415 555 0100"]
    made = docs_of(spark, [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)])
    for table in (odd, made):
        texts = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        expected = sorted((str(i), hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in texts)
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in pii.digests(table).collect()) == expected
    spans = pii.find(docs_of(spark, [(1, "my iban DE89370400440532013000 and DE89370400440532013001, order 371449635398431, amex card 371449635398431")])).first()["spans"]
    assert [s["kind"] for s in spans] == ["iban", "short_card"]
    clean = pii.redact(docs_of(spark, [(1, "mail a@b.co now"), (2, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["mail <EMAIL> now", None]


def test_redaction_of_each_kind(spark):
    texts = {
        "email": ("write to a.b@c.org now", "write to <EMAIL> now"), "ip": ("host 10.0.0.255 up, 1.2.3.999 not", "host <IP> up, 1.2.3.999 not"), "card": ("card 4111 1111 1111 1111.", "card <CARD>."),
        "phone": ("call +1 415 555 0100!", "call <PHONE>!"), "iban": ("iban DE89370400440532013000 ok", "iban <IBAN> ok"), "iban part": ("serial part DE89370400440532013000", "serial part DE89370400440532013000"),
        "short_card": ("😀 amex card 371449635398431, order", "😀 amex card 371449635398431, order"), "short_card kept": ("😀 amex card 371449635398431 é", "😀 amex card <SHORT_CARD> é"),
        "ssn": ("ssn 123-45-6789, ssn 987-65-4321", "ssn <SSN>, ssn 987-65-4321"), "ssn plain": ("number 123-45-6789", "number 123-45-6789"), "overlap": ("call x@1.2.3.4 or +4111111111111111", None), "two": ("a@b.co c@d.co", "<EMAIL> <EMAIL>"), "none": ("", ""),
    }
    docs = docs_of(spark, list(enumerate(t for t, _ in texts.values())))
    got = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    for found, (text, expected), row in zip(got, texts.values(), pii.find(docs).orderBy("doc_id").collect(), strict=True):
        at, parts = 0, []
        for s in sorted(row["spans"], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = max(at, s["end"])
        assert found == "".join(parts) + text[at:]
        assert expected is None or found == expected
    assert {s["kind"] for r in pii.find(docs).collect() for s in r["spans"]} == set(pii.PATTERNS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(500):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        b = [x if rng.random() > 0.2 else rng.randint(0, 5) for x in a if rng.random() > 0.1]
        most = rng.randint(0, 12)
        assert near_dup.edit_distance(np.array(a, np.int64), np.array(b, np.int64), most) == min(distance(a, b), most + 1)


def test_near_duplicates(spark, odd):
    rng = random.Random(3)
    text = lambda: [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(80)]
    bases = [text() for _ in range(6)]
    rows = []
    for k, base in enumerate(bases):
        for v in range(15):
            words = list(base)
            if v > 4:
                words[rng.randrange(80)] = f"edit{k}x{v}"
            rows.append((k * 100 + v, " ".join(words)))
    rows += [(1000 + i, " ".join(text())) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs_of(spark, rows)).collect()}
    assert got == {i: (i // 100 * 100 if i < 1000 else i) for i, _ in rows}
    rest = near_dup.classes(odd).collect()
    assert len(rest) == 8 and {(r["doc_id"], r["class_id"]) for r in rest} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (7, 7), (8, 8)}
    assert near_dup.classes(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    rng = random.Random(4)
    item = [rng.choice(WORDS) + str(i) for i in range(30)]
    near = list(item)
    near[7] = "changed"
    del near[20]
    far = [w if i % 2 else "zzz" for i, w in enumerate(item)]
    fill = ["filler", "words", "around"] * 10
    docs = docs_of(spark, [(1, " ".join(fill + item + fill)), (2, " ".join(fill + near)), (3, " ".join(far + fill)), (4, " ".join(fill)), (None, None)])
    items = spark.createDataFrame([(9, " ".join(item)), (10, None), (None, "a b c")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["distance"]) for r in decontaminate.findings(docs, items).orderBy("doc_id").collect()] == [(1, 9, 30, 0), (2, 9, 30, 2)]
    assert decontaminate.clean(docs, items).count() == 3
    assert decontaminate.findings(odd, items.limit(0)).count() == 0


def test_language_and_toxicity_models():
    rng = random.Random(6)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    kinds = {"aa": ["ba", "lo", "mi"], "bb": ["sch", "ung", "ter"]}
    texts, langs = zip(*[(make(s), k) for k, s in kinds.items() for _ in range(60)], strict=True)
    model = language.train(list(texts), list(langs))
    assert all(model.predict(make(s))[0] == k for k, s in kinds.items() for _ in range(20))
    assert model.predict("12 !!") == ("und", 0.0) and language.train([], []).predict("abc") == ("und", 0.0)
    y = [i % 3 == 0 for i in range(300)]
    toxic = toxicity.train([make(kinds["aa"]) + (" vileword " if t else " ") + make(kinds["aa"]) for t in y], [int(t) for t in y], ["aa"] * 300)
    buckets, scorer = toxicity.WordBuckets(), toxicity.Scorer(toxic)
    texts = [make(kinds["aa"]) + " vileword", make(kinds["aa"]), "", "one", "one two", " ".join([make(kinds["aa"])] * 700)]
    logits = scorer.logits(texts)
    assert toxic.shifted(logits[0], "aa") > 0.5 > toxic.shifted(logits[1], "aa") and all(0 <= toxic.shifted(z, "") <= 1 for z in logits)
    assert np.allclose(logits, [toxic.logit(buckets.of(t)) for t in texts], atol=1e-3)
    # a sample that halves the clean rows must not move the threshold: each stands for two
    z, y = np.array([0.0, 1, 2, 3, 4]), np.array([0, 0, 1, 0, 1])
    assert toxicity.best_threshold(z, y, np.ones(5)) != toxicity.best_threshold(z, y, np.where(y == 1, 1.0, 9.0))


def test_every_language_is_calibrated():
    """Thresholds by language at any number of rows: few rows stay near the common threshold, many move away from it."""
    rng = np.random.default_rng(3)
    y = np.arange(1500) % 2
    langs = ["aa"] * 1430 + ["bb"] * 40 + ["cc"] * 30
    texts = [" ".join(rng.choice(["plain", "calm", "word", "other"], 20)) + (" vileword" if t and rng.random() < 0.9 else "") for t in y]
    model = toxicity.train(texts, y.tolist(), langs)
    assert set(model.thresholds) == {"aa", "bb", "cc"}
    logits = np.array([3.0, 2.0, 1.0, 0.0])
    truth, own, common = np.array([1, 1, 0, 0]), np.array([0, 0, 1, 1]), np.ones(4)
    cut = lambda n: toxicity.best_threshold(np.tile(logits, 2), np.concatenate([truth, own]), np.concatenate([common * 5, np.array([0, n, n, 0.0])]))
    assert 1 < cut(1) < 2 and not 1 < cut(50) < 2


def test_toxicity_rows(spark, odd):
    languages = language.fit(odd)
    texts = [(i, ("vileword " if i % 3 == 0 else "") + f"some words about number{i} and more") for i in range(60)]
    docs = docs_of(spark, [*texts, (3, "another text of an id"), (None, "no id")])
    labels = spark.createDataFrame([*((i, int(i % 3 == 0)) for i in range(60)), (3, 0), (None, 1), (999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, languages)
    got = {r["doc_id"]: r for r in toxicity.score(docs.filter("doc_id <> 3"), model, languages).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in range(60) if i != 3]) > 0.9
    assert len(toxicity.score(odd, model, languages).collect()) == 8
    for few in (labels.limit(0), labels.filter("toxic = 1")):
        assert {r["score"] for r in toxicity.score(odd, toxicity.fit(docs, few, languages), languages).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model, languages).count() == 0


def test_language_rows(spark, odd):
    got = language.predict(odd, language.fit(odd)).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got} <= {"en", "und"}
    assert language.predict(odd, language.fit(odd.limit(0))).filter("lang_pred <> 'und'").isEmpty()
    assert language.predict(odd.limit(0), language.fit(odd)).count() == 0
    # more languages than rows are wanted: each still takes part; copies count once
    many = spark.createDataFrame([(i, "same old text" if i < 900 else f"text number {i}", f"l{i % 30}") for i in range(1000)], "doc_id long, text string, lang string")
    assert len(language.fit(many, most_rows=60).langs) == 30


def test_pieces_equal_the_library():
    tokens = token_store.PieceTokens(queries.WORD_TOKENIZER)
    rng = random.Random(3)
    signs = [chr(c) for c in [*range(0x2100), *rng.sample([c for c in range(0x2100, 0x110000) if not 0xD800 <= c < 0xE000], 6000)]]
    texts = [form.replace("{}", c) for form in ("{}", "a{}B1{}'s", "..{}'re <|x") for c in signs]
    texts += ["".join(rng.choices("aB1 '\"sStTLlreVE_-.\x1c\x1fé\u0301İ½<|>　\n²", k=rng.randint(0, 30))) for _ in range(5000)]
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokens.LIMIT = 1 << 16  # so that the memory is emptied between batches
    got = [x.tolist() for at in range(0, len(texts), 1000) for x in tokens.of(texts[at : at + 1000])]
    assert got == want


def test_license(spark):
    model = license_scan.train(["plain prose about rivers and hills\nand more of it"])
    docs = docs_of(spark, [(1, "prose\nReleased under the MIT License.\nprose"), (2, "The license fee was paid"), (3, None), (4, "Licensed under CC BY-NC 4.0.")])
    assert [(r["doc_id"], r["licence"]) for r in license_scan.scan(docs, model).orderBy("doc_id").collect()] == [(1, "MIT"), (2, None), (3, None), (4, "CC-BY-NC")]


def test_normalisers_sum_to_one():
    model = lm_score.LogBilinear.start(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    z = model.normalisers(3)
    h = model.context[5] * model.place[0] + model.context[3] * model.place[1]
    assert abs(np.exp(model.target @ h + model.bias - z[5]).sum() - 1) < 1e-4


def test_lm_scores(spark, odd):
    rows = lm_score.scores(odd).collect()
    assert len(rows) == 8
    texts = {r["doc_id"]: lm_score.tokens_of(r["text"] or "") for r in odd.collect()}
    assert all(r["n_tokens"] == len(texts[r["doc_id"]]) and r["score"] <= 0 and r["base_score"] < 0 for r in rows)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:400] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(600, None), (700, [0.0] * 16), (800, [float("nan")] * 16), (900, []), (None, [1.0] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda v: v % 100 == 0).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        hits += len({r[1] for r in own} & set(best.tolist()))
    assert hits >= 57 and len(got) == 60


@pytest.mark.parametrize("kind", ["large", "tiny", "tight", "mixed"])
def test_nearest_of_any_magnitude(spark, kind):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1200, 24))
    v = {"large": v * 1e200, "tiny": v * 1e-200, "tight": 1 + v * 3e-7, "mixed": v * 10.0 ** rng.integers(-9, 6, (1200, 1))}[kind]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(5000, [float("inf")] * 24, "x"), (5100, None, "x"), (5200, [0.0] * 24, "x"), (5300, [None] * 24, "x"), (5400, [1.0], "x")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, d string"), lambda i: i % 100 == 0).collect()
    assert {r["query_id"] for r in got} == set(range(0, 1200, 100)) and max(r["vec_id"] for r in got) < 1200
    hits = 0
    for q in range(0, 1200, 100):
        d = ann.lengths(v - v[q])
        best = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        own = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        hits += len(set(own) & {i for _, i in best})
        assert all(np.isclose(s, d[i], rtol=1e-12) for i, s in own.items())
    assert hits >= 108


def test_nearest_of_an_empty_table(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0


def test_components_and_crowded_pairs(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)]
    least = {v: v for e in edges for v in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["v"], r["c"]) for r in found) == sorted((v, least[v]) for v in linked)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(14):
        words = list(base)
        for at in range(0, 3 * (i % 7), 3):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"other{i}-{j}" for j in range(60)) for i in range(3)]
    words = near_dup.word_arrays(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["h"])
    rows = words.collect()
    both = words.select("h", "size", "bag", "odd")
    sizes = {r["h"]: r["size"] for r in rows}
    may = {(a, b) for a in sizes for b in sizes if abs(sizes[a] - sizes[b]) <= 0.2 * max(sizes[a], sizes[b]) + 1e-9}
    arrays = {r["h"]: np.array(r["words"]) for r in rows}
    keys = {h: near_dup.OrderMinHash().of(w.view(np.uint64)).view(np.int64).tolist() for h, w in arrays.items()}
    buckets = spark.createDataFrame([(h, k) for h, ks in keys.items() for k in ks], "h long, key long")
    prints = spark.createDataFrame(list(keys.items()), "h long, prints array<long>")
    asked = buckets.join(both, "h").join(prints, "h").withColumn("c", F.when(F.col("h") % 2 == 0, 1).otherwise(F.col("h")))
    component = {r["h"]: r["c"] for r in asked.select("h", "c").collect()}
    got = {(r["a"], r["b"]) for r in near_dup.crowded_pairs(asked).collect()}
    met = {(a, b) for a, b in may if a < b and component[a] != component[b] and set(keys[a]) & set(keys[b])}
    assert got <= met and all((a, b) in got for a, b in met if near_dup.similar(arrays[a], arrays[b]))
    every = spark.createDataFrame([(a, b) for a in arrays for b in arrays], "a long, b long")
    left = {(r["a"], r["b"]) for r in near_dup.plausible(every, both).collect()}
    assert len(left) < len(arrays) ** 2 and left <= may
    assert all((a, b) in left for a in arrays for b in arrays if near_dup.similar(arrays[a], arrays[b]))


def test_tiles_lose_no_pair(spark, monkeypatch):
    """A bucket cut into many tiles gives the same pairs as one tile."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(w if rng.random() > 0.08 else f"x{rng.integers(5)}" for w in base) for _ in range(90)]
    words = near_dup.word_arrays(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["h"])
    members = words.select("h", F.pmod("h", F.lit(2)).alias("key"), F.col("h").alias("c"), *near_dup.FACTS, F.array(F.pmod("h", F.lit(2))).alias("prints"))
    whole = {tuple(r) for r in near_dup.crowded_pairs(members).collect()}
    monkeypatch.setattr(near_dup, "TILE", 7)
    monkeypatch.setattr(near_dup, "STRIPE", 3)
    assert {tuple(r) for r in near_dup.crowded_pairs(members).collect()} == whole
    arrays = {r["h"]: np.array(r["words"]) for r in words.collect()}
    linked = {(a, b) for a in arrays for b in arrays if a < b and (a - b) % 2 == 0 and near_dup.similar(arrays[a], arrays[b])}
    assert linked and linked <= whole


@pytest.mark.parametrize("size,least", [(15, 0.85), (20, 0.85), (40, 0.95), (100, 0.95), (500, 0.95)])
def test_recall_at_the_least_similarity(size, least):
    """Pairs of edit similarity 0.8, with edits at random places and in every fifth word."""
    rng, sketch = np.random.default_rng(size), near_dup.OrderMinHash()
    for evenly in (False, True):
        met = 0
        for _ in range(100):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = a.copy()
            at = np.arange(2, size, 5) if evenly else rng.choice(size, size // 5, replace=False)
            b[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
            assert near_dup.similar(a, b)
            met += bool((sketch.of(a) == sketch.of(b)).any())
        assert met >= 100 * least


def test_classes_against_all_pairs(spark):
    """On a whole table: classes join linked texts only, and lose next to no link of the edit similarity that brute force finds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], near_dup.WordHashes().of(near_dup.words_of(r["text"] or ""))) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    links = [(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if len(x) and len(y) and near_dup.similar(x, y)]
    assert len(got) == len(texts) and len(links) > 5
    assert np.mean([got[a] == got[b] for a, b in links]) >= 0.9
    joined = {a: a for a, _ in texts}
    for _ in texts:
        for a, b in links:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert all(joined[i] == joined[c] for i, c in got.items())


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choice(WORDS) + str(i) for i in range(40)) for _ in range(4))
    docs = docs_of(spark, [(7, a), (7, b), (3, b), (9, c), (9, c), (None, d), (None, None), (5, ""), (5, " ")]).withColumn("id_", F.lit(1))
    kept = P.near_duplicates(spark, docs, "")
    assert kept.columns == P.COLUMNS
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(7, a), (3, b), (9, c), (0, d), (0, ""), (5, ""), (5, " ")])
    assert P.near_duplicates(spark, docs.limit(0), "").count() == 0
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == P.COLUMNS and sorted(r["text"] or "" for r in clean.collect()) == sorted([b, b, c, c, d, "", "", " "])
    assert P.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.personal_data(spark, docs, "").count() == 9 and P.byte_tokens(spark, docs, "").count() == 9
    langs = P.language_id(spark, docs, "")
    assert langs.columns == P.COLUMNS and sorted(r["text"] for r in langs.collect()) == sorted([a, b, b, c, c, d])
    assert [n for n, _ in P.STAGES] == ["language ID", "near duplicates", "decontamination", "personal data", "byte BPE"]


def test_one_candidate_rule_for_crowded_buckets(spark):
    """Pairs with a tenth of their words replaced, all of which share a passage: none that shares a bucket may be lost."""
    passage = [f"shared{i}" for i in range(55)]
    rows = []
    for k in range(60):
        base = [*passage, *(f"g{k}w{i}" for i in range(25))]
        other = [f"e{k}x{i}" if i >= 55 and i % 3 == 0 else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    words = {i: near_dup.WordHashes().of(t.split()) for i, t in rows}
    bands = {i: near_dup.OrderMinHash().of(w) for i, w in words.items()}
    linked = [(a, a + 1) for a in range(0, 120, 2) if near_dup.similar(words[a], words[a + 1])]
    meets = [(a, b) for a, b in linked if (bands[a] == bands[b]).any()]
    crowd = max(np.unique(np.concatenate(list(bands.values())), return_counts=True)[1])
    print("linked", len(linked), "sharing a bucket", len(meets), "found", sum(got[a] == got[b] for a, b in linked), "largest bucket", crowd)
    assert crowd > 8 and len(linked) == 60 and len(meets) > 20
    assert all(got[a] == got[b] for a, b in meets)


def test_empty_tables_and_repeated_rows(spark, odd):
    none = odd.limit(0)
    ranks, pattern = queries.BYTE_RANKS, public_tokenizers.PATTERN
    model = license_scan.fit(none)
    assert license_scan.scan(none, model).count() == pii.digests(none).count() == byte_bpe.round_trip_digests(none, ranks, pattern).count() == 0
    assert decontaminate.findings(none, spark.createDataFrame([(1, "some words of an item to find")], "item_id long, text string")).count() == 0
    text = "prose before\nReleased under the MIT License.\n" + "long line " * 5000
    rows = docs_of(spark, [(1, text), (1, text), (2, text + "\n" + text)])
    assert {r["licence"] for r in license_scan.scan(rows, model).collect()} == {"MIT"}
    for found in (pii.digests(rows), byte_bpe.round_trip_digests(rows, ranks, pattern)):
        first, second = found.filter("doc_id = 1").collect()
        assert first == second


def test_settled_pairs_meet_labels_once(spark, monkeypatch):
    """One link joins two components: the other 399 pairs of them are looked up once more, not in every round; crowded pairs bring their components."""
    met, relabelled = [], near_dup.relabelled
    monkeypatch.setattr(near_dup, "relabelled", lambda rows, labels, col, name: (met.append(rows.count()) if col == "b" else None, relabelled(rows, labels, col, name))[1])
    base = [f"w{i}" for i in range(60)]
    words = near_dup.word_arrays(spark.createDataFrame([(" ".join([*base, f"x{i}"]),) for i in range(40)], "text string"))
    h = sorted(r["h"] for r in words.select("h").collect())
    labels = spark.createDataFrame([(v, h[0] if i < 20 else h[20]) for i, v in enumerate(h)], "v long, c long")
    apart = spark.createDataFrame([(a, b, h[0], h[20]) for a in h[:20] for b in h[20:]], "a long, b long, ca long, cb long")
    after, links = near_dup.settled(apart, words, labels, labels.limit(0).toDF("a", "b"), (True, True, False))
    assert links.count() == 1 and {r["c"] for r in after.collect()} == {h[0]}
    assert sum(met) <= 399
    members = words.select("h", F.lit(0).cast("long").alias("key"), F.pmod("h", F.lit(7)).alias("c"), *near_dup.FACTS, F.array(F.lit(0).cast("long")).alias("prints"))
    got = near_dup.crowded_pairs(members, components_too=True).collect()
    assert got and all((r["ca"], r["cb"]) == (r["a"] % 7, r["b"] % 7) for r in got)


def test_most_frequent_tokens(spark, monkeypatch):
    """Frequent tokens reach the driver alone: counts that pass the bound go as a whole, the common tokens stay, and scores don't depend on the bound."""
    rows = [(f"t{i:03}".encode(), c) for i, c in enumerate([9, 7, 7, 5, *[3] * 6, *[1] * 40])]
    vocabulary = spark.createDataFrame(rows, "token binary, c long").repartition(3)
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert lm_score.most_frequent(vocabulary, 12, 2) == order[:10] and lm_score.most_frequent(vocabulary, 8, 2) == order[:4]
    assert lm_score.most_frequent(vocabulary, 3, 6) == order[:6] and lm_score.most_frequent(vocabulary, 99, 2) == order
    assert lm_score.most_frequent(vocabulary.limit(0), 9, 2) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    of = lambda: {r["doc_id"]: r for r in lm_score.scores(docs).collect()}
    whole = of()
    monkeypatch.setattr(lm_score, "HEAD", 1500)
    for i, r in of().items():
        assert r[:5] == whole[i][:5] and np.allclose([r["base_score"], r["score"]], [whole[i]["base_score"], whole[i]["score"]])


def test_lm_batches_of_texts(spark, odd, monkeypatch):
    """Batches split at once give each text's own tokens and runs, which meet in one shuffle; many normalisers come from one product."""
    texts = [r["text"] or "" for r in odd.collect()] + [" a\x0bB \x1c c\xa0d\t", "ÄÖ e\u0301 ÄÖ\r\nZ", "one", "\x1c", "\x85 x"]
    words, at, starts = lm_score.tokenised(pa.array(["cut off", *texts]).slice(1))
    own = [lm_score.tokens_of(t) for t in texts]
    assert words.take(pa.array(at)).to_pylist() == sum(own, []) and list(starts) == list(np.cumsum([0, *map(len, own)]))[:-1]
    assert lm_score.others(words).tolist() == [lm_score.other(t) for t in words.to_pylist()]

    common = [b"", b"text", b"a@b.co"]
    want = Counter()
    for tokens in own:
        ids = [0, 0, *(common.index(t) if t in common else lm_score.other(t) for t in tokens)]
        want.update((a * lm_score.CLASSES + b) * lm_score.CLASSES + c for a, b, c in zip(ids, ids[1:], ids[2:]))
    runs = lm_score.run_counts(docs_of(spark, enumerate(texts)).repartition(2), common, 0, 7)
    assert {r["code"]: r["n"] for r in runs.collect()} == want
    assert runs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(code") == 1 and runs.rdd.getNumPartitions() == 7
    assert {r["token"]: r["c"] for r in lm_score.token_counts(docs_of(spark, enumerate(texts))).collect()} == Counter(sum(own, []))

    rng = np.random.default_rng(1)
    for scale in (0.1, 20):  # the larger one leaves nothing of a plain product
        model = lm_score.LogBilinear.of(rng.normal(0, scale, len(lm_score.LogBilinear.start(np.ones(lm_score.CLASSES)).flat())).astype(np.float32))
        z = model.normalisers(np.array([0, 3, 1500]))
        first, second = (x.astype(float) for x in model.tables())
        for k, two in enumerate([0, 3, 1500]):
            for one in (0, 5, 1535):
                s = first[one] + second[two]
                assert z[k, one] == pytest.approx(s.max() + np.log(np.exp(s - s.max()).sum()))
    at, rows = rng.integers(0, 40, 500), rng.normal(size=(500, lm_score.DIM)).astype(np.float32)
    assert np.allclose(lm_score.summed(at, rows)[:40], [rows[at == i].sum(0) for i in range(40)], atol=1e-4)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = lm_score.scores(docs).agg(F.sum("score")).first()[0]
    monkeypatch.setattr(lm_score, "HELD", 5000)
    monkeypatch.setattr(lm_score, "FLUSH", 3000)
    monkeypatch.setattr(lm_score, "PART", 2000)
    rows = lm_score.scores(docs).collect()
    assert sum(r["score"] for r in rows) == pytest.approx(whole, rel=0.05)
    held = {r["doc_id"]: lm_score.tokens_of(r["text"] or "") for r in docs.collect()}
    counts = Counter(t for i, tokens in held.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens)
    total, floor = counts.total(), np.log10(counts.total() + 0.1 * (len(counts) + 1))
    for r in rows:
        tokens = held[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r["base_score"] == pytest.approx(sum(np.log10(counts[t] + 0.1) - floor for t in tokens))


def test_thresholds_come_from_all_labels(spark):
    """Labels that the bounded sample leaves out move the thresholds; rows that gradients came from don't."""
    model = toxicity.ToxicityModel()
    model.trained, model.fitted = True, [0, 1]
    rows = [(0, 9.0, "aa"), (1, -9.0, "aa"), *((10 + i, i / 10 - 2, "aa") for i in range(60)), *((100 + i, i / 10 - 2, "bb") for i in range(60)), (None, 0.0, "aa"), (999, 5.0, "cc")]
    scored = spark.createDataFrame(rows, "doc_id long, logit double, seen string")
    labels = [(0, 0), (1, 1), *((10 + i, int(i >= 30)) for i in range(60)), *((100 + i, int(i >= 40)) for i in range(60)), (None, 1), (5000, 1)]
    toxicity.calibrate(scored, spark.createDataFrame(labels, "doc_id long, toxic int"), model)
    assert set(model.thresholds) == {"aa", "bb"} and 0.9 <= model.thresholds["aa"] <= 1.0 and 1.9 <= model.thresholds["bb"] <= 2.0
    got = {r["doc_id"]: r for r in toxicity.shifted_scores(scored, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels[2:-2]) and got[999]["score"] == pytest.approx(model.shifted(5.0, "cc"))
    before = dict(model.thresholds)
    toxicity.calibrate(scored, spark.createDataFrame(labels[:2], "doc_id long, toxic int"), model)
    assert model.thresholds == before
    toxicity.calibrate(scored, spark.createDataFrame([], "doc_id long, toxic int"), none := toxicity.ToxicityModel())
    assert {r["score"] for r in toxicity.shifted_scores(scored, none).collect()} == {0.0}
