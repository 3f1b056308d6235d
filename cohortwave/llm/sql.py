"""SQL for the queries of this folder that SQL can express whole."""

from __future__ import annotations

#: Words are compared as strings, so the rows rest on no hash of ours; sets that are equal are one entity, links are followed by recursion.
JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), named AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, dense_rank() OVER (ORDER BY s) AS e, s FROM sets
), ones AS MATERIALIZED (
  SELECT e, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY e
), entries AS MATERIALIZED (
  SELECT e, n, unnest(s) AS g FROM ones
), links AS MATERIALIZED (
  SELECT a.e AS a, b.e AS b
  FROM entries a JOIN entries b ON a.g = b.g AND a.e <> b.e AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.e, b.e, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT e, e AS f FROM ones
  UNION
  SELECT reach.e, links.b FROM reach JOIN links ON reach.f = links.a
), lowest AS (
  SELECT e, min(doc_id) AS low FROM named WHERE n > 0 GROUP BY e
), roots AS (
  SELECT reach.e, min(low) AS component_id FROM reach JOIN lowest ON reach.f = lowest.e GROUP BY reach.e
)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id
FROM named LEFT JOIN roots USING (e)
"""


def _draw(path: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5('tree/{path}:' || key), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / {weight}"


def _pick(*options: tuple[str, int, str]) -> str:
    """The outcome of the option (path, weight, outcome) of the least draw."""
    draws = [_draw(path, weight) for path, weight, _ in options]
    cases = " ".join(f"WHEN {d} <= least({', '.join(draws)}) THEN {o[2]}" for d, o in zip(draws, options))
    return f"(CASE {cases} END)"


def _rack(g: int, k: int) -> str:
    return _pick(*[(f"g{g}/k{k}/s{s}", 1, str(s)) for s in (2 * k, 2 * k + 1)])


def _region(g: int) -> str:
    return _pick(*[(f"g{g}/k{k}", 2, _rack(g, k)) for k in (2 * g, 2 * g + 1)])


#: Eight shards in racks of two and regions of two racks, all of weight 1; the ninth is a region of its own. The polynomial 3988292384 is that of CRC-32.
SHARD_TREE = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT)) AS t
), rows AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS bytes FROM documents
), placed AS (
  SELECT doc_id, key, (octet_length(bytes) + 1)::BIGINT AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
    {_pick(*[(f"g{g}", 4, _region(g)) for g in (0, 1)])}::INTEGER AS shard,
    {_pick(*[(f"g{g}", 4, _region(g)) for g in (0, 1)], ("x8", 1, "8"))}::INTEGER AS grown_shard
  FROM rows, steps
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, size, text_crc32) - 1)::BIGINT AS slot
FROM placed
"""

#: Windows are joined as strings; a short item is a window of its own length.
BENCHMARK_WINDOWS = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), seen AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size)
), hits AS MATERIALIZED (
  SELECT doc_id, i, size, item_id FROM seen JOIN grams USING (g, size)
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
