"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM base GROUP BY source
), weighted AS (
  SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM src
), rounds AS (
  SELECT 0 AS round, place, weight, cap, total, FALSE AS capped FROM weighted
  UNION ALL
  SELECT round + 1, place, weight, cap, total, capped OR cap < weight * level FROM (
    SELECT *, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () AS level FROM rounds
  ) WHERE round < (SELECT count(*) FROM src)
), settled AS (
  SELECT *, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () AS level
  FROM rounds WHERE round = (SELECT count(*) FROM src)
), targets AS (
  SELECT w.*, CASE WHEN s.capped THEN s.cap ELSE s.weight * s.level END AS target, ceil(w.total / 8)::BIGINT AS blocks FROM weighted w JOIN settled s USING (place)
), source_seats AS (
  SELECT place, count(*)::BIGINT AS source_blocks FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, place, j) AS r, blocks
    FROM targets, generate_series(0, ceil(target / 4)::BIGINT) AS g(j) WHERE target > 0
  ) WHERE r <= blocks GROUP BY place
), placed AS (
  SELECT b.*, t.place, t.source_size, t.target, coalesce(s.source_blocks, 0) AS source_blocks, md5('11:' || coalesce(b.doc_id::VARCHAR, '')) AS ord, t.n_docs
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN source_seats s USING (place)
), dealt AS (
  SELECT *, ('0x' || substr(ord, 1, 8))::BIGINT % ceil(n_docs / 2000.0)::BIGINT AS shard FROM placed
), shards AS (
  SELECT place, shard, sum(size)::BIGINT AS words, any_value(source_blocks) AS source_blocks FROM dealt GROUP BY place, shard
), seats AS (
  SELECT place, shard, count(*)::BIGINT AS quota FROM (
    SELECT place, shard, source_blocks, row_number() OVER (PARTITION BY place ORDER BY words / (2 * j + 1) DESC, shard, j) AS r
    FROM shards, generate_series(0, source_blocks) AS g(j) WHERE words > 0
  ) WHERE r <= source_blocks GROUP BY place, shard
), stream AS (
  SELECT d.*, sh.words, least(coalesce(q.quota, 0) * 8, sh.words * 3) AS quota_words,
    coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM dealt d JOIN shards sh USING (place, shard) LEFT JOIN seats q USING (place, shard)
), rounded AS (
  SELECT *, CASE WHEN words > 0 THEN quota_words // words ELSE 0 END AS rounds FROM stream
)
SELECT doc_id, size, source_size, target, (rounds * size + least(greatest(quota_words - rounds * words - start, 0), size))::BIGINT AS taken FROM rounded
"""

OP6 = f"""
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, verdict DESC) AS r
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE r = 1
"""

OP9 = f"""
WITH normal AS (SELECT doc_id, {LOWER.format("text")} AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM normal JOIN groups USING (t)
"""

OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant'
), escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS role_out, replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>') AS text_out FROM rows
), whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, text_out)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, text_out), '')) AS loss_sha256,
    sum(length('<turn >') + length(role_out) + length(text_out) + length('</turn>') + 1)::BIGINT AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT * FROM whole
"""

ORACLE = {"op5_mix_sources": OP5, "op6_url_rules": OP6, "op8_chat_format": OP8, "op9_exact_dedup": OP9}
