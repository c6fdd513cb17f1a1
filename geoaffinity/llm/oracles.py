"""The queries of the subpackage in DuckDB SQL, where SQL can express them."""

from .chat import BEGIN, CONTROL, FRAMES, OTHER


def _escaped(text: str) -> str:
    """SQL for the length of an escaped text: each backslash and each control string adds to it."""
    sql = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\|{c[1:]}')"
    return f"length({sql})"


def _framed() -> str:
    known = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in FRAMES.items())
    return f"CASE {known} ELSE {sum(map(len, OTHER))} + {_escaped('role')} END + {_escaped('text')}"


ORACLES = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
           FROM documents),
     g AS (SELECT norm, count(*) AS group_size,
                  arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id
           FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
    "op9_source_mix": r"""
WITH d AS (SELECT doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
           FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                  [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
           FROM d GROUP BY source),
     f AS (SELECT *, row_number() OVER o AS step,
                  sum(source_size) OVER ()::BIGINT
                    - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l,
                  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
           FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST)),
     v AS (SELECT l, rest FROM f WHERE l * w <= cap * rest ORDER BY step LIMIT 1),
     t AS (SELECT source, source_size,
                  CASE WHEN f.l * w > cap * f.rest THEN cap::DOUBLE
                       ELSE (w * v.l)::DOUBLE / v.rest::DOUBLE END AS target
           FROM f, v),
     r AS (SELECT doc_id, size, source_size, target,
                  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                  ('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM r
""",
    "op3_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
             FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                   FROM iw WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT k FROM win),
     dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                  FROM dw, lens WHERE len(w) >= k)),
     hits AS (SELECT DISTINCT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
     hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits))
            GROUP BY doc_id),
     hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op10_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM (SELECT conv_id, turn, role, text FROM conversations
                 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(BEGIN)} + sum({_framed()}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op11_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
     o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
     f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
           FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2))
                  // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p
           FROM f),
     l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM f GROUP BY lang, term),
     q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2))
                  // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q
           FROM l),
     apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
               GROUP BY a.lang, a.source, b.source),
     pair AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value
              FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
              LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
     best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
              FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
     ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
                UNION ALL
                SELECT lang, source, 'term', item, value,
                       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM best)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
