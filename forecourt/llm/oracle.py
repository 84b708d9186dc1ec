"""SQL with the same results as the queries, for the operators that SQL can express."""

from __future__ import annotations

# Words: runs of characters other than ASCII white space.
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str, breaks: str = _SPACE) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{breaks}'), lambda w: w <> '')"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

NEARDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
-- A pair's shared shingles; equal texts make classes first, so that copies are not expanded.
c AS (SELECT list_sort(s) AS s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY 1),
k AS (SELECT id, len(s) AS n, unnest(s) AS g FROM c),
l AS (
  SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS root FROM c UNION SELECT b.b, r.root FROM r JOIN both_ways b ON b.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id,
  coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.id
"""

_TERM_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"), _TERM_BREAKS)} AS w FROM documents),
b AS (SELECT item_id, {_words(_LOWER.format("coalesce(text, '')"), _TERM_BREAKS)} AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
-- Windows of the documents of every size that an item has.
o AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, z.size, unnest(range(1, len(w) - z.size + 2)) AS s
        FROM d, (SELECT DISTINCT size FROM i) z WHERE len(w) >= z.size)),
h AS (SELECT o.doc_id, o.s, o.size, i.item_id FROM o JOIN i ON o.g = i.g AND o.size = i.size),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
o AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM o),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM f WHERE first < doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS n_gone,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(
      list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, n_gone::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

#: Levels of the trees in the SQL: up to 8^9 rows of a language and 8^4 languages.
LEAF_LEVELS, NAME_LEVELS = 9, 4


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, by half bytes."""
    # The checksum's remainders of the 16 half bytes, fixed values.
    table = (
        "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, "
        "3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    )
    half = f"xor(({{0}}) >> 4, ({table})[(({{0}}) & 15) + 1])"
    step = half.format(half.format("xor(a, b)"))
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"


def _digest(columns: list[str]) -> str:
    sized = (f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"sha256({' || '.join(sized)})"


def _tree(name: str, levels: int) -> str:
    """Levels ``name``0 to ``name``N of (g, p, n, d): digests and places by group, and with each run its siblings."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT g, p // 8 AS p, (n + 7) // 8 AS n, "
            f"CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d, "
            f"list(d ORDER BY p) AS run FROM {name}{k} GROUP BY g, p // 8, n)"
        )
    return ",\n".join(out)


def _path(name: str, levels: int, start: str, proof: str, source: str, keep: str) -> str:
    """Steps of folding and of the proof from ``source`` (g, p, n, ...) up the levels of a tree."""
    out, at = [], source
    for k in range(levels):
        slot = f"(s.p // {8**k}) % 8"
        left = f"array_to_string(t.run[1:{slot}], '')"
        right = f"array_to_string(t.run[{slot} + 2:], '')"
        many = f"s.n > {8**k}"
        out.append(
            f"{name}_path{k + 1} AS (SELECT {keep}, CASE WHEN {many} THEN sha256({left} || s.{start} || {right}) ELSE s.{start} END AS {start}, "
            f"CASE WHEN {many} THEN s.{proof} || {left} || {right} ELSE s.{proof} END AS {proof} "
            f"FROM {at} s JOIN {name}{k + 1} t ON t.g = s.g AND t.p = s.p // {8 ** (k + 1)})"
        )
        at = f"{name}_path{k + 1}"
    return ",\n".join(out)


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

MANIFEST = f"""
WITH v AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_digest(_FIELDS)} AS d,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_digest([*_FIELDS[:4], _LOWER.format("text")])} END AS other
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM v),
leaf0 AS (SELECT g, p, n, d FROM r),
{_tree("leaf", LEAF_LEVELS)},
names AS (SELECT g AS name, d, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS n FROM leaf{LEAF_LEVELS}),
name0 AS (SELECT g, p, n, d FROM names),
{_tree("name", NAME_LEVELS)},
start AS (SELECT doc_id, d AS leaf, g, p, n, coalesce(other, d) AS fold, '' AS proof FROM r),
{_path("leaf", LEAF_LEVELS, "fold", "proof", "start", "s.doc_id, s.leaf, s.g, s.p, s.n")},
middle AS (
  SELECT s.doc_id, s.leaf, s.fold, s.proof, '' AS g, t.p, t.n, t.d AS subroot
  FROM leaf_path{LEAF_LEVELS} s JOIN names t ON t.name = s.g),
{_path("name", NAME_LEVELS, "fold", "proof", "middle", "s.doc_id, s.leaf, s.g, s.p, s.n, s.subroot")}
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.d AS verified
FROM name_path{NAME_LEVELS} s CROSS JOIN name{NAME_LEVELS} t
"""

ORACLES: dict[str, str] = {
    "op3_warc": WARC,
    "op7_neardup": NEARDUP,
    "op8_decontamination": DECONTAMINATION,
    "op9_substring": SUBSTRING,
    "op12_manifest": MANIFEST,
}
