"""The results of some operators in SQL, for tables of a size at which all pairs and windows can be written out."""

from __future__ import annotations

#: op2: the windows of 400 bytes by their digests, islands of repeated ones, and what is left of the bytes.
OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), w AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, (len(x) // 2) - 399)) AS i FROM d WHERE len(x) >= 800)
), again AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN again USING (h)
), island AS (
  SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k
), gap AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM island
), cut AS (
  SELECT r, count(*) AS spans, sum(b - a) AS gone, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || any_value(substr(x, 2 * (SELECT max(b) FROM island i WHERE i.r = gap.r) + 1)) AS rest
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, d.x))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

#: op3: the sets of shingles, the pairs that share one, links, and what they reach.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS own
  FROM w
), e AS (
  SELECT r, len(own) AS n, unnest(own) AS h FROM s
), pairs AS (
  SELECT a.r AS a, b.r AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.r <> b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)
), reach AS (
  SELECT r AS a, r AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
  SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY a
), equal AS (
  SELECT a AS r, min(doc_id) AS other FROM pairs JOIN s ON s.r = pairs.b WHERE c = n AND c = m GROUP BY a
)
SELECT s.doc_id, len(own)::BIGINT AS n_shingles, component_id, coalesce(least(s.doc_id, other), s.doc_id) AS class_id
FROM s JOIN component USING (r) LEFT JOIN equal USING (r)
"""


def _op7() -> str:
    """op7: the matches of each rule, with places from the pieces between them."""
    from lodestrata.llm.secret_scan import BASE, RULES

    parts = []
    for k, (kind, pattern, _) in enumerate(RULES):
        own = pattern.replace("++", "+").replace("}+", "}").replace("'", "''")
        parts.append(f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{own}') AS m, regexp_split_to_array(t, '{own}') AS p FROM d")
    assign = RULES[0][1].replace("'", "''")
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k})::BIGINT AS n_{kind}" for k, kind in enumerate(BASE))
    zeros = ", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in BASE)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  {' UNION ALL '.join(parts)}
), each AS (
  SELECT r, k, kind, m[i] AS x, list_sum(list_transform(p[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)
), spans AS (
  SELECT r, k, kind, s::BIGINT AS s, (s + length(x))::BIGINT AS e FROM each
  WHERE (k <> 0 OR length(regexp_extract(x, '{assign}', 1)) >= 6) AND (k <> 1 OR length(x) >= 20)
), told AS (
  SELECT r, {counts}, {told} FILTER (WHERE k < {len(BASE)}) AS base, {told} AS spans FROM spans GROUP BY r
)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""


def _op4() -> str:
    """op4: the draws of the hash tree, slots by row numbers, and the crc32 of a text byte by byte."""
    from lodestrata.llm.sharding import BUCKETS, tree

    def least(children: list[tuple[str, float, str]]) -> str:
        draw = "-ln((('0x' || substr(md5(key || '/{}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {}"
        if len(children) == 1:
            return children[0][2]
        structs = ", ".join(f"{{'d': {draw.format(path, weight)}, 'i': {i}}}" for i, (path, weight, _) in enumerate(children))
        cases = " ".join(f"WHEN {i} THEN {then}" for i, (_, _, then) in enumerate(children))
        return f"(CASE list_min([{structs}]).i {cases} END)"

    def shard(count: int) -> str:
        regions = []
        for region in tree(count):
            racks = [(f"rack{rack[0][0]}", sum(w for _, w in rack), least([(f"shard{s}", w, str(s)) for s, w in rack])) for rack in region]
            regions.append((f"region{region[0][0][0]}", sum(w for _, w, _ in racks), least(racks)))
        return least(regions)

    return f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, hex(encode(coalesce(text, ''))) AS x,
    list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
  FROM documents
), r AS (
  SELECT doc_id, key, (len(x) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d
), p AS (
  SELECT doc_id, size, text_crc32, {shard(16)} AS shard, {shard(17)} AS grown_shard,
    ('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32)), 1, 8))::BIGINT % {BUCKETS} AS bucket
  FROM r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op4_sharding": _op4(), "op7_secret_scan": _op7()}
