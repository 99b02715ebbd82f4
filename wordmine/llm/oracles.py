"""DuckDB SQL for the queries that SQL can express.

The other operators apply trained models, tokenizers or Spark's hash functions,
which SQL has no like of; their tests hold them against brute force.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# CRC-32, by its table of 256 entries.
_CRC_TABLE = """crc_table AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce(
                list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""


def _crc32(s: str) -> str:
    """The unsigned CRC-32 of an ASCII text, where ``crc_table`` is in reach."""
    return f"""xor(list_reduce(
                list_concat([4294967295::BIGINT],
                    list_transform(range(1, strlen({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


def _leaf(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


ORACLES: dict[str, str] = {
    # Every pair of documents with a common shingle, and all that links reach.
    "op6_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                '[^\x20\x09-\x0D]+') AS l
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(l) = 0 THEN []
                     WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                     ELSE [array_to_string(l[i:i + 4], ' ') for i in range(1, len(l) - 3)]
                END) AS g
            FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS MATERIALIZED (
            SELECT a, b
            FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * c >= 75 * (p.n + q.n - c)),
        r AS (
            SELECT doc_id AS node, doc_id AS m FROM w
            UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.m)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id
        FROM w JOIN r ON r.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
        GROUP BY w.doc_id, n.n""",
    # Every prefix of every rebuilt conversation as the text of its turns' hashes.
    "op11_conversation_trie": rf"""
        WITH {_CRC_TABLE},
        t AS MATERIALIZED (
          SELECT conv_id, m, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos
          FROM (SELECT *, sha256(strlen(r) || ':' || r || x) AS m,
                  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k
                FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
                      FROM conversations WHERE conv_id IS NOT NULL))),
        c AS MATERIALIZED (
          SELECT conv_id, {_crc32('conv_id::VARCHAR')} % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM t), crc_table),
        b AS (
          SELECT c.conv_id, pos, m, k FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
          UNION ALL
          SELECT c.conv_id, pos, m, k FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
        p AS MATERIALIZED (
          SELECT conv_id, 0 AS d, '' AS s, 0 AS k FROM c
          UNION ALL
          SELECT conv_id, row_number() OVER o, string_agg(m, '') OVER o, k FROM b
          WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        ends AS (
          SELECT s, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS e
          FROM (SELECT conv_id, arg_max(s, d) AS s FROM p GROUP BY conv_id) GROUP BY s),
        n AS MATERIALIZED (
          SELECT s, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(k) AS saved
          FROM p GROUP BY s),
        kids AS (SELECT left(s, -64) AS s, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        -- A node's ancestors are the beginnings of its smallest member.
        sub AS (
          SELECT p.s, sum(saved) AS saved_tokens, count(*) FILTER (NOT EXISTS (FROM kids WHERE kids.s = n.s)) AS n_leaves
          FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.s)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
          n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
        FROM n JOIN sub ON sub.s = n.s LEFT JOIN n u ON n.depth > 0 AND u.s = left(n.s, -64)
        LEFT JOIN kids ON kids.s = n.s LEFT JOIN ends ON ends.s = n.s""",
    # Every tree level by level, then every row folded along its path.
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        l AS MATERIALIZED (
          SELECT doc_id, lang, {_leaf('text')} AS leaf,
            CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS other
          FROM documents, crc_table),
        p AS MATERIALIZED (
          SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        -- Nodes of each language's tree, level by level.
        a AS (
          SELECT g, 0 AS lvl, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p
          UNION ALL
          SELECT g, lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8
          FROM a WHERE n > 1 GROUP BY g, lvl, pos // 8),
        -- The same over the languages.
        b AS (
          SELECT 0 AS lvl, g - 1 AS pos, d, count(*) OVER () AS n FROM a WHERE n = 1
          UNION ALL
          SELECT lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8
          FROM b WHERE n > 1 GROUP BY lvl, pos // 8),
        runs AS MATERIALIZED (
          SELECT g, lvl, pos // 8 AS run, list(d ORDER BY pos) AS ds FROM a WHERE n > 1 GROUP BY g, lvl, pos // 8),
        tops AS MATERIALIZED (
          SELECT lvl, pos // 8 AS run, list(d ORDER BY pos) AS ds FROM b WHERE n > 1 GROUP BY lvl, pos // 8),
        steps AS (
          SELECT p.g, p.pos, lvl, ds, (p.pos >> (3 * lvl)) % 8 AS k
          FROM p JOIN runs ON runs.g = p.g AND runs.run = p.pos >> (3 * lvl + 3)
          UNION ALL
          SELECT p.g, p.pos, 100 + lvl, ds, ((p.g - 1) >> (3 * lvl)) % 8
          FROM p JOIN tops ON tops.run = (p.g - 1) >> (3 * lvl + 3)),
        paths AS MATERIALIZED (
          SELECT g, pos, row_number() OVER (PARTITION BY g, pos ORDER BY lvl) AS i,
            array_to_string(ds[:k], '') AS lft, array_to_string(ds[k + 2:], '') AS rgt
          FROM steps),
        f AS (
          SELECT g, pos, 0 AS i, coalesce(other, leaf) AS d FROM p
          UNION ALL
          SELECT f.g, f.pos, f.i + 1, sha256(lft || d || rgt)
          FROM f JOIN paths ON paths.g = f.g AND paths.pos = f.pos AND paths.i = f.i + 1),
        folded AS (SELECT g, pos, arg_max(d, i) AS d FROM f GROUP BY g, pos),
        proofs AS (SELECT g, pos, string_agg(lft || rgt, '' ORDER BY i) AS w FROM paths GROUP BY g, pos)
        SELECT p.doc_id, p.leaf, s.d AS subroot, r.d AS root, sha256(coalesce(w, '')) AS proof_sha256,
          folded.d AS folded_root, folded.d = r.d AS verified
        FROM p JOIN (SELECT g, d FROM a WHERE n = 1) s ON s.g = p.g
        CROSS JOIN (SELECT d FROM b WHERE n = 1) r
        JOIN folded ON folded.g = p.g AND folded.pos = p.pos
        LEFT JOIN proofs ON proofs.g = p.g AND proofs.pos = p.pos""",
    "op13_warc_archives": r"""
        WITH p AS MATERIALIZED (
          SELECT page_id, strlen(x) AS payload_bytes, x, sha1(x) AS s,
            CASE WHEN url IS NULL THEN ''
              WHEN position('://' IN u) = 0 THEN u
              ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(u, '://([^/?]*)', 1)), '.')), ',') || ')' ||
                CASE WHEN regexp_extract(u, '://[^/?]*(.*)', 1) = '' THEN '/' ELSE regexp_extract(u, '://[^/?]*(.*)', 1) END
              END AS url_key,
            strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured
          FROM (SELECT page_id, url, coalesce(html, '') AS x, regexp_replace(url, '#.*', '') AS u FROM pages)),
        g AS (SELECT x, max(page_id) AS first FROM p GROUP BY x)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to,
          url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) AS place
        FROM p JOIN g USING (x)""",
}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
