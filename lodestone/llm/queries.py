"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import embeddings, lexical, merkle, packing, pieces, quality, scoring, separators, sharding, simhash, substrings, suffixes, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1,
    "op2_toxicity": toxicity.op2,
    "op3_suffix_array_dedup": suffixes.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_lm_scoring": scoring.op5,
    "op6_sentencepiece": pieces.op6,
    "op7_packing": packing.op7,
    "op8_substring_dedup": substrings.op8,
    "op9_quality_rules": quality.op9,
    "op10_token_counts": separators.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_lexical_search": lexical.op12,
    "op13_sharding": sharding.op13,
}
#: DuckDB has no crc32: eight steps a byte, over hex text.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({0}) // 2), lambda i: ('0x' || substr({0}, 2 * i + 1, 2))::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


def _fields(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in columns)


#: DuckDB's SQL for the operators that it can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
 walk AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT w.root, l.b FROM walk w JOIN links l ON l.a = w.node),
 low AS (SELECT root, min(node) AS component_id FROM walk GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low ON root = vec_id LEFT JOIN n ON a = vec_id""",
    "op3_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 u AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, h FROM d),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= length(h) THEN md5_number(substr(h, 2 * i + 1, 100)) END AS win FROM u),
 f AS (SELECT *, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS flag FROM w),
 c AS (SELECT *, max(flag) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
 g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
 w AS (SELECT doc_id, i, x, CASE WHEN i + 50 <= n THEN md5_number(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS win FROM u),
 f AS (SELECT *, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS flag FROM w),
 c AS (SELECT *, max(flag) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
 g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM d),
 g AS (SELECT doc_id, i, x = lag(x) OVER o AS same, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS win FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM g WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, range(5) AS q(k) GROUP BY 1),
 a AS (SELECT doc_id, count(*) FILTER (same) AS n_adjacent FROM g GROUP BY 1),
 m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_adjacent, 0) AS n_adjacent,
  length(t) - length(replace(t, '!', '')) AS n_exclaims, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_exclaims > n_words OR 10 * n_upper > 4 * n_letters
 OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_adjacent > 2 * n_words) AS kept FROM b""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_fields('doc_id', 'source', 'lang', 'n_chars', 'text')}) AS leaf, sha256({_fields('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')}) AS other, {_CRC.format('hex(encode(doc_id::VARCHAR))')} % 7 = 0 AS bad FROM documents),
 l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
 nodes AS (SELECT lang, 0 AS lev, i, leaf AS h, n FROM l UNION ALL SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lev, i // 2),
 subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
 tops AS (SELECT 0 AS lev, i, subroot AS h, n FROM subs UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lev, i // 2),
 every AS (SELECT lang, lev, i, h FROM nodes UNION ALL SELECT s.lang, 100 + lev, t.i, t.h FROM tops t, subs s),
 up AS (SELECT l.doc_id, l.lang, l.i, 0 AS base, range(CASE WHEN l.n = 1 THEN 0 ELSE ceil(log2(l.n))::INT END) AS levs FROM l UNION ALL SELECT l.doc_id, l.lang, s.i, 100, range(CASE WHEN s.n = 1 THEN 0 ELSE ceil(log2(s.n))::INT END) FROM l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang),
 walk AS (SELECT doc_id, lang, base + lev AS lev, i >> lev AS at FROM (SELECT doc_id, lang, i, base, unnest(levs) AS lev FROM up)),
 path AS (SELECT w.doc_id, w.lang, list(CASE WHEN e.h IS NULL THEN '-' WHEN w.at & 1 = 1 THEN 'L' || e.h ELSE 'R' || e.h END ORDER BY w.lev) AS steps FROM walk w LEFT JOIN every e ON e.lang IS NOT DISTINCT FROM w.lang AND e.lev = w.lev AND e.i = xor(w.at, 1) GROUP BY ALL),
 r AS (SELECT h AS root FROM tops WHERE n = 1),
 p AS (SELECT l.doc_id, leaf, subroot, root, CASE WHEN bad THEN other ELSE leaf END AS start, coalesce(steps, []) AS steps FROM l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN r LEFT JOIN path ON path.doc_id = l.doc_id AND path.lang IS NOT DISTINCT FROM l.lang),
 f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> '-'), lambda x: substr(x, 2)), '')) AS proof_sha256, list_reduce(list_prepend(start, steps), lambda a, x: sha256(CASE left(x, 1) WHEN 'L' THEN substr(x, 2) || a WHEN 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM f""",
    "op12_lexical_search": r"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
 m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM n, s),
 f AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
 c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50""",
    "op13_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents),
 k AS (SELECT *, ('0x' || substr(md5(t), 1, 15))::BIGINT AS a, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS b FROM d),
 o AS (SELECT *, sum(size) OVER w - size AS below, sum(size) OVER w AS upto, sum(size) OVER () AS total, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM k WINDOW w AS (ORDER BY a, b)),
 e AS (SELECT upto, total, CASE WHEN a2 IS NULL THEN 0 WHEN a <> a2 THEN len(list_filter([48, 42, 36, 30, 24, 18, 12, 6, 0], lambda s: xor(a, a2) >> s = 0)) ELSE 9 + len(list_filter([48, 42, 36, 30, 24, 18, 12, 6, 0], lambda s: xor(b, b2) >> s = 0)) END AS lev FROM o UNION ALL SELECT 0, max(total), 0 FROM o),
 c AS (SELECT s, upto, lev, abs(24 * upto - s * total) AS off, 1000 * abs(24 * upto - s * total) <= 2 * total AS near FROM e, range(1, 24) AS r(s)),
 -- the coarsest edge within the tolerance, and of those the nearest; else the nearest of all
 x AS (SELECT s, arg_min(upto, (CASE WHEN near THEN lev ELSE 99 END, off, upto)) AS edge FROM c GROUP BY s),
 g AS (SELECT o.*, (SELECT count(*) FROM x WHERE edge <= o.below)::INT AS shard FROM o)
SELECT doc_id, size, {_CRC.format('hex(encode(t))')} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY a, b) - 1 AS slot, NULL::INT AS grown_shard FROM g""",
}
