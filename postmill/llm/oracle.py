"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM folded
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""

ORACLE["op1_fingerprints"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents
), neighbours AS (
  SELECT *,
    coalesce(lead(doc_id) OVER down, first_value(doc_id) OVER whole) AS next_id,
    coalesce(lead(text) OVER down, first_value(text) OVER whole) AS following
  FROM base WINDOW down AS (ORDER BY doc_id DESC),
    whole AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edits AS (
  SELECT doc_id, next_id, n_chars, text, concat(substr(text, 1, n_chars - n_chars // 2), substr(following, 1, n_chars // 2)) AS edited
  FROM neighbours
), texts AS (
  SELECT doc_id, 0 AS kind, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits
), words AS (
  SELECT doc_id, kind, text, string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' ') AS words FROM texts
), marks AS (
  SELECT doc_id, kind, unnest(list_concat(
    list_transform(range(1, len(words) + 1), lambda i: concat(words[i], ' ', coalesce(words[i + 1], ''))),
    flatten(list_transform(list_filter(words, lambda w: length(w) > 16),
      lambda w: list_transform(range(1, length(w) - 6), lambda i: substr(w, i, 8)))))) AS mark
  FROM words
), turns AS (
  SELECT doc_id, kind, mark, row_number() OVER (PARTITION BY doc_id, kind, mark) - 1 AS turn FROM marks
), least AS (
  SELECT doc_id, kind, list_sort(list(DISTINCT substr(md5(concat(mark, ' ', turn)), 1, 8)))[1:64] AS least FROM turns GROUP BY ALL
), trees AS (
  SELECT doc_id, kind,
    list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256(p))) AS tree
  FROM texts
), prints AS (
  SELECT doc_id, kind, tree, least, list_transform(tree, lambda s: sha256(array_to_string(s, ''))) AS nodes,
    concat(sha256(concat(array_to_string(nodes, ''), array_to_string(least, ''))), ':', array_to_string(least, '')) AS fingerprint
  FROM trees JOIN least USING (doc_id, kind)
), located AS (
  SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, p.fingerprint, q.fingerprint AS edited_fingerprint,
    p.least AS a, q.least AS b, n.least AS c, p.tree, q.tree AS edited_tree,
    list_sort(list_distinct(list_concat(p.least, q.least)))[1:64] AS with_edited,
    list_sort(list_distinct(list_concat(p.least, n.least)))[1:64] AS with_next,
    list_filter(range(greatest(len(p.nodes), len(q.nodes))), lambda i: p.nodes[i + 1] IS DISTINCT FROM q.nodes[i + 1])[1] AS section
  FROM edits e JOIN prints p ON p.doc_id = e.doc_id AND p.kind = 0 JOIN prints q ON q.doc_id = e.doc_id AND q.kind = 1
    JOIN prints n ON n.doc_id = e.next_id AND n.kind = 0
), branches AS (
  SELECT *, coalesce(tree[section + 1], []) AS inside, coalesce(edited_tree[section + 1], []) AS edited_inside,
    len(list_intersect(list_intersect(a, b), with_edited)) AS like_edited, len(list_intersect(list_intersect(a, c), with_next)) AS like_next
  FROM located
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  2 * like_edited / (len(with_edited) + like_edited) AS near_edited,
  2 * like_next / (len(with_next) + like_next) AS near_next,
  section::INTEGER AS changed_section,
  CASE WHEN section IS NOT NULL THEN
    list_filter(range(greatest(len(inside), len(edited_inside))), lambda i: inside[i + 1] IS DISTINCT FROM edited_inside[i + 1])[1]::INTEGER
  END AS changed_paragraph
FROM branches
"""

# Targets: sources by the share of weight at which they reach their limit; those that reach
# theirs below the common share stop there, and the share is what is left by the weight left.
ORACLE["op5_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(sha256(concat('0:', coalesce(doc_id::VARCHAR, ''))), 1, 15) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INTEGER]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS ceiling FROM sources
), ordered AS (
  SELECT *, (SELECT sum(source_size) FROM sources)::DOUBLE AS whole,
    coalesce(sum(ceiling) OVER below, 0) AS held, sum(weight) OVER above AS free
  FROM weighed
  WINDOW below AS (ORDER BY ceiling / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    above AS (ORDER BY ceiling / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), share AS (
  SELECT (whole - held) / free AS unit FROM ordered WHERE ceiling / weight >= (whole - held) / free
  ORDER BY ceiling / weight, rank LIMIT 1
), targets AS (
  SELECT source, source_size, least(ceiling, weight * unit) AS target FROM ordered, share
), placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS quota,
    (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE
    size * (quota // source_size) + greatest(0, least(size, quota % source_size - place)) END)::BIGINT AS taken
FROM placed
"""

# States of places: 0 open, 1 kept, 2 lost; a round looks at the first kept and the first open place of each piece.
ORACLE["op8_line_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, list_transform(lines, lambda l: ('0x' || substr(md5(l), 1, 8))::BIGINT) AS hashes,
    list_transform(lines, lambda l: len(regexp_extract_all(l, '[^ \t\r]+'))) AS words
  FROM split
), bordered AS (
  SELECT *, list_filter(range(len(lines)), lambda i: i = len(lines) - 1
      OR words[i + 1] >= 50 OR coalesce(words[i + 2], 0) >= 50
      OR (hashes[i + 1] + 31 * coalesce(CASE WHEN i > 0 THEN hashes[i] END, 0)) % 3 = 0) AS ends
  FROM hashed
), numbered AS (
  SELECT doc_id, words, ends, unnest(range(len(ends))) AS number FROM bordered
), chunks AS (
  SELECT doc_id, words, number, CASE WHEN number > 0 THEN ends[number] + 1 ELSE 0 END AS start, ends[number + 1] AS stop FROM numbered
), worded AS (
  SELECT doc_id, unnest(range(len(lines))) AS line, unnest(words) AS own FROM bordered
), summed AS (
  SELECT *, sum(own) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM worded WHERE own > 0
), spans AS (
  SELECT doc_id, start, stop FROM chunks WHERE stop > start AND list_sum(words[start + 1:stop + 1]) > 0
  UNION
  SELECT a.doc_id, a.line, b.line FROM summed a ASOF JOIN summed b ON a.doc_id = b.doc_id AND a.upto - a.own + 50 <= b.upto
  UNION
  SELECT a.doc_id, b.line, a.line FROM summed a ASOF JOIN summed b ON a.doc_id = b.doc_id AND a.upto - 50 >= b.upto - b.own
), pieces AS (
  SELECT doc_id, start, stop, array_to_string(lines[start + 1:stop + 1], chr(10)) AS key FROM spans JOIN split USING (doc_id)
), again AS (
  SELECT * FROM pieces QUALIFY count(*) OVER (PARTITION BY key) > 1
), rounds AS (
  SELECT 0 AS round, doc_id, start, stop, key, 0 AS state FROM again
  UNION ALL
  SELECT round + 1, doc_id, start, stop, key, CASE WHEN goes THEN 2 WHEN may_go THEN 0 ELSE 1 END
  FROM (
    SELECT y.round, y.doc_id, y.start, y.stop, y.key, bool_or(z.goes) AS goes, bool_or(z.may_go) AS may_go
    FROM rounds y JOIN (
      SELECT p.doc_id, p.start, p.stop,
        coalesce(kept.doc_id < p.doc_id OR (kept.doc_id = p.doc_id AND kept.start + p.stop - p.start < p.start), false) AS goes,
        coalesce(free.doc_id < p.doc_id OR (free.doc_id = p.doc_id AND free.start + p.stop - p.start < p.start), false) AS may_go
      FROM rounds p JOIN (
        SELECT key, min({'doc_id': doc_id, 'start': start}) FILTER (WHERE state = 1) AS kept,
          min({'doc_id': doc_id, 'start': start}) FILTER (WHERE state != 2) AS free
        FROM rounds GROUP BY key
      ) f ON f.key = p.key
    ) z ON z.doc_id = y.doc_id AND z.start <= y.stop AND z.stop >= y.start
    GROUP BY ALL
  )
  WHERE EXISTS (FROM rounds WHERE state = 0)
), places AS (
  SELECT * FROM rounds WHERE round = (SELECT max(round) FROM rounds)
), gone AS (
  SELECT DISTINCT p.doc_id, unnest(range(p.start, p.stop + 1)) AS line
  FROM places p JOIN (SELECT key, min({'doc_id': doc_id, 'start': start}) AS kept FROM places WHERE state = 1 GROUP BY key) f ON f.key = p.key
  WHERE kept.doc_id < p.doc_id OR (kept.doc_id = p.doc_id AND kept.start + p.stop - p.start < p.start)
), lost AS (
  SELECT g.doc_id, list(line) AS gone_lines, count(DISTINCT number) AS removed_chunks
  FROM gone g JOIN chunks c ON c.doc_id = g.doc_id AND line BETWEEN c.start AND c.stop GROUP BY g.doc_id
)
SELECT d.doc_id,
  CASE WHEN gone_lines IS NULL THEN d.text ELSE array_to_string(list_transform(
    list_filter(range(len(lines)), lambda i: NOT list_contains(gone_lines, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
  coalesce(len(lines), 0)::INTEGER AS n_lines, coalesce(len(gone_lines), 0)::INTEGER AS removed_lines, coalesce(removed_chunks, 0)::INTEGER AS removed_chunks
FROM documents d LEFT JOIN split s USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

# The CRC is that of the bytes of a decimal number, bit by bit.
ORACLE["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (
  SELECT conv_id, turn, role, length(text) AS size, sha256(concat(length(role), ':', role, text)) AS digest FROM turns
), placed AS (
  SELECT conv_id, size, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS place FROM hashed
), convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), range(8)),
        lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS taken
  FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, place, size, digest FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 100 AND place < taken
  UNION ALL
  SELECT c.conv_id, 1, place, size, digest FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place >= taken
), members AS (
  SELECT conv_id, row_number() OVER first_turns AS depth, size, sha256(string_agg(digest, '') OVER first_turns) AS key,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rebuilt WINDOW first_turns AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM members GROUP BY key
), parents AS (
  SELECT n.key, p.key AS parent_key FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 JOIN nodes p ON p.key = m.key
), children AS (
  SELECT n.key, count(p.key) AS n_children FROM nodes n LEFT JOIN parents p ON p.parent_key = n.key GROUP BY n.key
), subtrees AS (
  SELECT m.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes n JOIN children USING (key) JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
  GROUP BY m.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN children USING (key) JOIN subtrees USING (key) LEFT JOIN parents USING (key) LEFT JOIN nodes p ON p.key = parent_key
"""

ORACLE["op12_hyperminhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM split
), sized AS (
  SELECT doc_id, len(shingles)::BIGINT AS n, shingles FROM sets
), long AS (
  SELECT doc_id, n, unnest(shingles) AS shingle FROM sized
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n_u, b.n AS n_v, count(*) AS n_both
  FROM long a JOIN long b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
  GROUP BY ALL
), links AS (
  SELECT u, v FROM shared WHERE 100 * n_both >= 85 * (n_u + n_v - n_both)
), reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT reached.node, links.v FROM reached JOIN links ON links.u = reached.other
), lowest AS (
  SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN lowest ON node = doc_id
"""
