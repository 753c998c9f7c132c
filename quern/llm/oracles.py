"""DuckDB SQL for the queries of this subpackage that SQL can express. The others have no SQL form (trained models, tries,
XXH64 and sketches) and are tested against brute force."""

from __future__ import annotations

_CHUNKS = [f"('0x' || substr(hx, {5 * k + 1}, 5))::BIGINT" for k in range(8)]
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({v}) >> {s}) & 31)::INT + 1, 1)" for v in _CHUNKS for s in (15, 10, 5, 0))

_OP1 = f"""
WITH hashed AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hx FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hx, n) AS first_id, row_number() OVER (PARTITION BY hx, n ORDER BY page_id NULLS LAST) AS place FROM hashed)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to, url AS target_uri FROM firsts
"""

_OP4 = """
WITH masses AS (SELECT source, SUM(coalesce(strlen(text), 0) + 1)::BIGINT AS mass FROM documents GROUP BY source),
rates AS (SELECT source, (floor(sqrt(mass)) / (SELECT SUM(floor(sqrt(mass))) FROM masses)::DOUBLE) * 1.0::DOUBLE * (SELECT SUM(mass) FROM masses)::DOUBLE / mass::DOUBLE AS rate FROM masses),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 16.0::DOUBLE))::INT AS n FROM rates),
cdf AS (SELECT source, k, SUM(exp(-rate / n + k * ln(rate / n) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY source ORDER BY k) AS c FROM parts, range(0, 81) AS r(k)),
draws AS (SELECT doc_id, source, (('0x' || substr(md5('poisson|42|' || doc_id || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
          FROM (SELECT doc_id, source, unnest(range(1, n + 1)) AS j FROM documents JOIN parts USING (source))),
counts AS (SELECT d.doc_id, COUNT(*) AS n FROM draws d JOIN cdf ON cdf.source = d.source AND cdf.c < d.u GROUP BY d.doc_id),
copies AS (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counts)
SELECT doc_id, copy::INT AS copy, source, rate, md5('order|42|' || doc_id || '|' || copy) AS shuffle_key, text
FROM copies JOIN documents USING (doc_id) JOIN rates USING (source)
"""

#: One step of CRC-32 (reflected polynomial 0xEDB88320) for a table value.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_OP6 = f"""
WITH steps AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: {_BIT}) AS v FROM range(256) AS r(b))),
sized AS (SELECT doc_id, text, coalesce(strlen(text), 0)::BIGINT + 16 AS size FROM documents),
summed AS (SELECT *, SUM(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run, SUM(size) OVER () AS total FROM sized),
placed AS (SELECT *, least(39, (40 * (2 * run - size)) // (2 * total))::INT AS shard FROM summed),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)
SELECT doc_id, size, CASE WHEN b IS NULL THEN NULL ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)]))) END AS text_crc32,
  'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed JOIN bytes USING (doc_id), steps
"""

#: Every window of every document: shared shingles with multiplicity, over the shingles at the hits' positions alone.
_WORDS = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
_OP9 = f"""
WITH docs AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL) WHERE ws[1] <> ''),
items AS (SELECT item_id, ws, len(ws) AS m, least(len(ws), 5) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE ws[1] <> ''),
wanted AS (SELECT item_id, m, size, array_to_string(ws[p:p + size - 1], ' ') AS sh, COUNT(*) AS times FROM (SELECT *, unnest(range(1, m - size + 2)) AS p FROM items) GROUP BY ALL),
places AS (SELECT doc_id, n, size, p, array_to_string(ws[p:p + size - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, n - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM items))),
hits AS (SELECT doc_id, item_id, p, sh, times, n, m, least(n, m) - size + 1 AS own, m - size + 1 AS its FROM places JOIN wanted USING (size, sh)),
near AS (SELECT doc_id, item_id, any_value(n) AS n, any_value(m) AS m, any_value(own) AS own, any_value(its) AS its FROM hits GROUP BY doc_id, item_id HAVING COUNT(*) >= 0.8 / 1.8 * (any_value(own) + any_value(its)) - 1e-9),
windows AS (SELECT DISTINCT h.doc_id, h.item_id, unnest(range(greatest(1, h.p - h.own + 1), least(h.p, greatest(h.n - h.m, 0) + 1) + 1)) AS s FROM hits h JOIN near USING (doc_id, item_id)),
shared AS (SELECT doc_id, item_id, s, sh, least(COUNT(*), any_value(times)) AS k FROM windows JOIN hits USING (doc_id, item_id) WHERE p BETWEEN s AND s + own - 1 GROUP BY ALL),
scored AS (SELECT doc_id, item_id, s, SUM(k)::DOUBLE AS k FROM shared GROUP BY ALL),
likened AS (SELECT doc_id, item_id, s, least(n, m) AS n_words, k / (own + its - k) AS similarity FROM scored JOIN near USING (doc_id, item_id))
SELECT doc_id, item_id, (s - 1)::INT AS start_word, n_words::INT AS n_words, similarity FROM likened WHERE similarity >= 0.8::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""

#: Unsigned CRC-32 of a column of decimal integers, by the table of _OP6.
_CRC_STEPS = f"steps AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: {_BIT}) AS v FROM range(256) AS r(b)))"


def _crc_of_decimal(c: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({c}::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)])))"


def _framed(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END" for c in columns)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11 = f"""
WITH RECURSIVE {_CRC_STEPS},
leaves AS (SELECT doc_id, lang, sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
  CASE WHEN {_crc_of_decimal("doc_id")} % 3 = 0 THEN sha256({_framed("doc_id", "source", "lang", "n_chars", _LOWERED)}) END AS other FROM documents, steps),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, COUNT(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (SELECT lang, 0 AS lvl, place, leaf AS h, n FROM placed
  UNION ALL SELECT lang, lvl + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY lang, lvl, place // 8),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, COUNT(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS lvl, place, h, n FROM subroots
  UNION ALL SELECT lvl + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 7) // 8) FROM crown WHERE n > 1 GROUP BY lvl, place // 8),
steps_up AS (SELECT doc_id, p.place AS leaf_place, p.lang, leaf, coalesce(other, leaf) AS start, s.h AS subroot, s.place AS tree_place, lvl, false AS high, p.place >> (3 * lvl) AS own, p.n FROM placed p
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM p.lang
  UNION ALL SELECT doc_id, p.place, p.lang, leaf, coalesce(other, leaf), s.h, s.place, lvl, true, s.place >> (3 * lvl), p.n FROM placed p
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, (SELECT DISTINCT lvl FROM crown WHERE n > 1)),
runs AS (SELECT u.doc_id, u.leaf_place, u.lang, u.high, u.lvl, string_agg(k.h, '' ORDER BY k.place) FILTER (k.place < own) AS l, string_agg(k.h, '' ORDER BY k.place) FILTER (k.place > own) AS r FROM steps_up u JOIN (
    SELECT lang, false AS high, lvl, place, h FROM tree WHERE n > 1 UNION ALL SELECT NULL, true, lvl, place, h FROM crown WHERE n > 1) k
  ON k.high = u.high AND k.lvl = u.lvl AND k.place // 8 = u.own // 8 AND (u.high OR k.lang IS NOT DISTINCT FROM u.lang) GROUP BY ALL),
ordered AS (SELECT lang, leaf_place, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY high, lvl) AS path FROM runs GROUP BY ALL),
folds AS (SELECT p.lang, p.place, 1 AS i, coalesce(other, leaf) AS h, path FROM placed p LEFT JOIN ordered o ON o.lang IS NOT DISTINCT FROM p.lang AND o.leaf_place = p.place
  UNION ALL SELECT lang, place, i + 1, sha256(path[i].l || h || path[i].r), path FROM folds WHERE i <= coalesce(len(path), 0))
SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(list_reduce(list_prepend('', list_transform(path, lambda x: x.l || x.r)), lambda a, b: a || b), '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM crown WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN folds f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place AND f.i = coalesce(len(path), 0) + 1
"""

_OP12 = f"""
WITH {_CRC_STEPS},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc_of_decimal("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), steps),
raw AS (SELECT c.conv_id, 0 AS part, t.pos, t.said, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.said, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
path AS (SELECT conv_id, 0 AS depth, '' AS prefix, NULL AS parent, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, depth, prefix, left(prefix, strlen(prefix) - 32), chars FROM (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(said, '') OVER w AS prefix, length(text) AS chars FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos))),
lengths AS (SELECT conv_id, MAX(depth) AS depth FROM path GROUP BY conv_id),
ends AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM path JOIN lengths USING (conv_id, depth) GROUP BY prefix),
nodes AS (SELECT prefix, any_value(parent) AS parent, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * any_value(chars) AS saved FROM path GROUP BY prefix, depth),
kids AS (SELECT parent AS prefix, COUNT(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (prefix)),
subtrees AS (SELECT v.prefix, COUNT(*) FILTER (w.n_children = 0) AS n_leaves, SUM(w.saved) AS saved_tokens FROM known v JOIN known w ON starts_with(w.prefix, v.prefix) GROUP BY v.prefix)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known v JOIN subtrees USING (prefix) LEFT JOIN nodes p ON p.prefix = v.parent LEFT JOIN ends e ON e.prefix = v.prefix
"""

#: The exact neighbours. The search is approximate, but over a shard of a few hundred rows it finds all of them.
_OP13 = """
WITH usable AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id))::INT AS rank, c.vec_id, list_distance(q.v, c.v) AS score
FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id) <= 10
"""

ORACLES: dict[str, str] = {"op1_warc_pages": _OP1, "op4_mix_sources": _OP4, "op6_shard_documents": _OP6, "op9_decontamination": _OP9, "op11_merkle_manifest": _OP11, "op12_prefix_trie": _OP12, "op13_nearest_neighbours": _OP13}
