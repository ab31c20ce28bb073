"""The Merkle manifest against a tree built in plain Python: many sizes of sources, nulls, repeated rows, other columns."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from genmeta.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, node string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    """The root, and for each leaf its (siblings before, after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
            paths[i].append((run[: a % 16], run[a % 16 + 1 :]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [a // 16 for a in at]
    return nodes[0], paths


def expected(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[s] = tree([leaf(r, r[1]) for r in sources[s]])
    root, outer = tree([built[s][0] for s in order])
    out = []
    for s, above in zip(order, outer, strict=True):
        subroot, paths = built[s]
        for r, path in zip(sources[s], paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1])
            for before, after in [*path, *above]:
                now = h(*before, now, *after)
            proof = h(*(x for before, after in [*path, *above] for x in [*before, *after]))
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(1, None, None, None, None), (None, "No id", "en", "b", 5), (2**60 + 1, "Ünï😀 CODE", "en", "b", 9), (7, "x" * 100_000 + "Y", "en", "", 100_001), (7, "Other", "de", "", 5), (8, "same", "en", "", 4), (8, "same", "en", "", 4)]
    for n, source in ((1, "one"), (16, "run"), (17, "run and one"), (257, "Z"), (300, "é"), (2, None)):
        rows += [(1000 * n + 3 * i, f"Text {i} OF {source}", "en", source, i) for i in range(n)]
    rows += [(i, "lone SOURCE", "en", f"s{i:03}", 1) for i in range(40)]
    docs = spark.createDataFrame([(*r, "t", 5, "n") for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest(docs, merkle.every_fifth())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(5, "Only", "en", None, 4, "t", 5, "n")], SCHEMA)
    (only,) = merkle.manifest(docs).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["proof_sha256"] == h() and only["verified"]
    assert merkle.manifest(docs.limit(0), merkle.every_fifth()).collect() == []
