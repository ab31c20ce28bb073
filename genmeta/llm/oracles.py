"""The corpus queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

#: crc32 of the decimal doc_id: its table of 256 values, built by the polynomial, and a fold over the digits.
CRC = "crc_steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"
CRC_OF_ID = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    return f"sha256(array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), {text}], lambda v: coalesce(strlen(v) || ':' || v, '-')), ''))"


def _tree(name: str) -> str:
    """Levels and paths of the trees in the table name(tree, pos, h, now, n)."""
    return f"""{name}_up(tree, lvl, pos, h, n) AS (SELECT tree, 0, pos, h, n FROM {name} UNION ALL SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
 {name}_path(tree, start, lvl, pos, now, n, proof) AS (SELECT tree, pos, 0, pos, now, n, '' FROM {name} UNION ALL
  SELECT p.tree, p.start, p.lvl + 1, p.pos // 16, sha256(string_agg(CASE WHEN u.pos = p.pos THEN p.now ELSE u.h END, '' ORDER BY u.pos)), (p.n + 15) // 16, p.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> p.pos), '')
  FROM {name}_path p JOIN {name}_up u ON u.tree = p.tree AND u.lvl = p.lvl AND u.pos // 16 = p.pos // 16 WHERE p.n > 1 GROUP BY p.tree, p.start, p.lvl, p.pos, p.n, p.proof)"""


MERKLE = f"""
WITH RECURSIVE {CRC}, hashed AS (
 SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS h,
  CASE WHEN {CRC_OF_ID} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS now FROM documents, crc_table
), leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
 {_tree("leaves")},
 subroots AS (SELECT '' AS tree, tree AS source_tree, h, h AS now, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM leaves_up WHERE n = 1),
 own AS (SELECT * FROM leaves_path WHERE n = 1),
 {_tree("subroots")},
 root AS (SELECT h AS root FROM subroots_up WHERE n = 1),
 both_(tree, start, lvl, pos, now, n, proof, place) AS (
  SELECT o.tree, o.start, 0, s.pos, o.now, s.n, o.proof, s.pos FROM own o JOIN subroots s ON s.source_tree = o.tree UNION ALL
  SELECT p.tree, p.start, p.lvl + 1, p.pos // 16, sha256(string_agg(CASE WHEN u.pos = p.pos THEN p.now ELSE u.h END, '' ORDER BY u.pos)), (p.n + 15) // 16, p.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> p.pos), ''), p.place
  FROM both_ p JOIN subroots_up u ON u.lvl = p.lvl AND u.pos // 16 = p.pos // 16 WHERE p.n > 1 GROUP BY p.tree, p.start, p.lvl, p.pos, p.n, p.proof, p.place)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.root, sha256(b.proof) AS proof_sha256, b.now AS folded_root, b.now = r.root AS verified
 FROM both_ b JOIN leaves l ON l.tree = b.tree AND l.pos = b.start JOIN subroots s ON s.source_tree = b.tree, root r WHERE b.n = 1
"""
