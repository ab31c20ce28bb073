"""SentencePiece encoding against the library, text by text."""

import hashlib
import random

import pytest

from genmeta.llm import piece_bpe, queries

SCHEMA = "doc_id long, text string, ids string, n_tokens long"


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(queries.PIECE_MODEL)


def pieces(seed, n):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\t", "é", "é", "12", "!", "　", "▁", "▁▁", "ab" * 9, "😀", "ing", "tion", "<s>", "<0x41>", "\x00", "数据", "ﬁ", "İ", "\r\n", "ка", "==", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_equals_the_library(bpe):
    rng = random.Random(3)
    texts = pieces(1, 400) + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x100, 0x600), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    texts += ["", " ", " " * 1000, "x" * 5000, "xy" * 40_000, "ab" * 3000, "▁" * 37 + "word", "数" * 2000, "".join(bpe.piece[rng.choice(list(bpe.piece))] for _ in range(4000))]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == bpe.core.encode(text), repr(text[:80])
        assert bpe.decode(ids) == bpe.core.decode(ids)


def test_every_piece_and_code_point(bpe):
    for p in bpe.score:
        assert bpe.encode(p) == bpe.core.encode(p)
    for code in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 97), 0x10FFFF]:
        assert bpe.encode(chr(code)) == bpe.core.encode(chr(code))


def test_table_has_the_last_token_of_each_prefix(bpe):
    for word in ["▁internationalization", "▁▁▁▁▁x", "▁a😀bc", "the" * 9]:
        for end, token in enumerate(bpe.last_tokens(word), 1):
            parts = bpe.merged(word[:end])
            assert parts[-1] == (bpe.piece[token] if token >= 0 else chr(~token))


def test_pairs_against_the_rule(bpe):
    rng = random.Random(5)
    ids = list(bpe.piece)
    by_start = {}
    for i in ids:
        by_start.setdefault(bpe.piece[i][0], []).append(i)
    for _ in range(6000):
        a = rng.choice(ids)
        b = rng.choice(ids if rng.random() < 0.3 else by_start[rng.choice("aeinorst▁" + bpe.piece[a][-1])] if bpe.piece[a][-1] in by_start else ids)
        assert bpe.compatible(a, b) == (bpe.merged(bpe.piece[a] + bpe.piece[b]) == [bpe.piece[a], bpe.piece[b]]), (bpe.piece[a], bpe.piece[b])
    assert all(bpe.compatible(piece_bpe.NOTHING, a) == (bpe.merged(bpe.piece[a]) == [bpe.piece[a]]) for a in ids)


def test_memory_of_words_and_pairs_is_bounded(bpe, monkeypatch):
    monkeypatch.setattr(piece_bpe.PieceBpe, "WORDS", 5)
    monkeypatch.setattr(piece_bpe.PieceBpe, "PAIRS", 7)
    small = piece_bpe.PieceBpe(queries.PIECE_MODEL)
    for text in pieces(2, 30):
        assert small.encode(text) == bpe.core.encode(text)
        assert len(small.known) <= 5 and len(small.older) <= 5 and len(small.pairs) <= 7


def test_rows(spark, bpe):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "same text"), (4, "same text"), (None, "no id"), (7, "long words " * 30_000), (8, "y" * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = bpe.core.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(bpe.core.decode(ids) if ids else "")))
    assert sorted(map(tuple, piece_bpe.round_trip_digests(docs, queries.PIECE_MODEL).collect()), key=str) == sorted(want, key=str)
    back = piece_bpe.decode(piece_bpe.encode(docs, queries.PIECE_MODEL), queries.PIECE_MODEL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back if r["doc_id"]) == sorted((i, t or "") for i, t in rows if i)
    assert piece_bpe.round_trip_digests(docs.limit(0), queries.PIECE_MODEL).collect() == []
