"""SQL of the training-data queries, where SQL can say it.

Tokenizers, XXH64, trained models and approximate search are beyond it: packing, SimHash, language identification,
quality, embeddings and the language model are held against brute force or held-out accuracy in the tests.
"""

from __future__ import annotations

from .chat import END, START
from .licenses import GRAM, LOWER, NEAR, NOTICES, PHRASES, SHORT, SIMILAR, UPPER, WORD
from .merkle import BLOCK_CHARS, SECTION_BLOCKS, SECTION_DIGITS
from .mixing import HASH_DIGITS, LONG_SHARE, MOST_EPOCHS, WEIGHTS


MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, {HASH_DIGITS}))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {float(MOST_EPOCHS)}::DOUBLE AS most,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, rank,
         CASE WHEN most <= weight * level THEN most
              ELSE weight * first_value(CASE WHEN most > weight * level THEN level END IGNORE NULLS)
                   OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, d.size * {LONG_SHARE} <= t.source_size AS is_short,
         coalesce(floor(t.target / nullif(t.source_size, 0) + 1e-12), 0)::BIGINT AS rounds, d.h
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, target - rounds * source_size AS rest, sum(size) OVER (PARTITION BY rank, is_short) AS class_size,
         coalesce(sum(size) OVER (PARTITION BY rank, is_short ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + size / 2.0 AS middle
  FROM p
), g AS (
  SELECT *, NOT is_short AND size > 0 AND middle < rest * class_size / nullif(source_size, 0) AS long_in FROM m
), k AS (
  SELECT *, coalesce(sum(CASE WHEN long_in THEN size END) OVER (PARTITION BY rank), 0) AS long_words FROM g
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN (rounds + (long_in OR (is_short AND middle < rest - long_words))::BIGINT) * size ELSE 0 END::BIGINT AS taken
FROM k
"""

_LEAVES = rf"regexp_extract_all(%s, '[^\n]{{1,{BLOCK_CHARS}}}\n?|\n')"
_DIGESTS = f"list_transform({_LEAVES}, lambda x: sha256(x))"
_SECTIONS = (
    f"list_transform(range(0, len(%s), {SECTION_BLOCKS}), lambda i: sha256(array_to_string(list_slice(%s, i + 1, i + {SECTION_BLOCKS}), '')))"
)

FINGERPRINTS = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following, length(text) // 4 AS k FROM d
), e AS (
  SELECT doc_id, text, following, substr(text, 1, length(text) - k) || substr(following, 1, k) AS edited FROM n
), g AS (
  SELECT doc_id, text, edited, {_DIGESTS % "text"} AS a, {_DIGESTS % "edited"} AS b, {_DIGESTS % "following"} AS c FROM e
), s AS (
  SELECT *, {_SECTIONS % ("a", "a")} AS sa, {_SECTIONS % ("b", "b")} AS sb, {_SECTIONS % ("c", "c")} AS sc FROM g
), r AS (
  SELECT *, sha256('root:' || array_to_string(sa, '')) AS ra, sha256('root:' || array_to_string(sb, '')) AS rb,
         sha256('root:' || array_to_string(sc, '')) AS rc,
         list_transform(a, lambda x: substr(x, 1, 8)) AS la, list_transform(b, lambda x: substr(x, 1, 8)) AS lb,
         list_transform(c, lambda x: substr(x, 1, 8)) AS lc
  FROM s
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       ra || ':' || array_to_string(list_transform(sa, lambda x: substr(x, 1, {SECTION_DIGITS})), '') || ':' || array_to_string(la, '') AS fingerprint,
       rb || ':' || array_to_string(list_transform(sb, lambda x: substr(x, 1, {SECTION_DIGITS})), '') || ':' || array_to_string(lb, '') AS edited_fingerprint,
       CASE WHEN ra = rb THEN 1.0::DOUBLE WHEN len(la) + len(lb) = 0 THEN 0.0
            ELSE least(2.0::DOUBLE * len(list_intersect(la, lb)) / (len(list_distinct(la)) + len(list_distinct(lb))), 0.999999::DOUBLE) END AS near_edited,
       CASE WHEN ra = rc THEN 1.0::DOUBLE WHEN len(la) + len(lc) = 0 THEN 0.0
            ELSE least(2.0::DOUBLE * len(list_intersect(la, lc)) / (len(list_distinct(la)) + len(list_distinct(lc))), 0.999999::DOUBLE) END AS near_next
FROM r
"""

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x,
         replace(replace(replace(coalesce(role, ''), '%', '%25'), '<', '%3C'), chr(10), '%0A') AS shown_role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS shown
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(shown_role) + length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM p
), b AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(digest, 5 * i + 1, 5))::BIGINT) AS words FROM g
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(words, lambda w: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 15) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 5) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (w & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM b
"""

_TEMPLATES = ", ".join("({}, '{}', '{}', {})".format(i, t.replace("'", "''"), label, i < len(PHRASES)) for i, (t, label) in enumerate([*PHRASES, *NOTICES]))
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
# ROW of words i to i + k - 1 as one string; a line break is no part of a word
_GRAM = "array_to_string(list_slice(words, i + 1, i + k), chr(10))"

LICENSES = rf"""
WITH t AS (
  SELECT *, len(words) AS m, least(len(words), {GRAM}) AS k,
         CASE WHEN exact OR len(words) < {SHORT} THEN 1.0::DOUBLE ELSE {SIMILAR}::DOUBLE END AS least
  FROM (SELECT template, label, exact, {_WORDS} AS words FROM (VALUES {_TEMPLATES}) v(template, text, label, exact))
), g AS (
  SELECT template, k, i AS p, {_GRAM} AS gram FROM (SELECT *, unnest(range(0, m - k + 1)) AS i FROM t)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), w AS (
  SELECT row, i, k, {_GRAM} AS gram
  FROM (SELECT row, words, k, unnest(range(0, len(words) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM t))
), v AS (
  SELECT row, template, i - p AS diagonal, list(p) AS ps, count(*) AS votes
  FROM w JOIN g USING (k, gram) GROUP BY ALL
), s AS (
  SELECT a.row, a.template, a.diagonal, any_value(a.votes) AS votes, any_value(a.ps) AS own,
         arg_max(b.diagonal, (b.votes, -b.diagonal)) AS strongest,
         list_distinct(flatten(list(list_transform(b.ps, lambda p: p)))) AS ps,
         min(b.diagonal + list_min(b.ps)) AS first, max(b.diagonal + list_max(b.ps)) AS last
  FROM v a JOIN v b ON a.row = b.row AND a.template = b.template AND b.diagonal BETWEEN a.diagonal - {NEAR} AND a.diagonal + {NEAR}
  GROUP BY a.row, a.template, a.diagonal
), c AS (
  SELECT row, label, exact, diagonal, exact AND votes = m - k + 1 AS place, strongest = diagonal AS peak, least,
         CASE WHEN exact THEN (votes = m - k + 1)::INTEGER::DOUBLE
              ELSE len(list_distinct(flatten(list_transform(ps, lambda p: range(p, p + k))))) / greatest(m, last + k - first)::DOUBLE END AS similarity
  FROM s JOIN t USING (template)
), f AS (
  SELECT *, CASE WHEN exact THEN place ELSE peak AND similarity >= least END AS found FROM c
), r AS (
  SELECT row, count(*) FILTER (WHERE place) AS n_base, min(diagonal) FILTER (WHERE place) AS first_word, max(diagonal) FILTER (WHERE place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(similarity) FILTER (WHERE found) AS score
  FROM f GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (row)
"""

NEGATIVES = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, len(embedding) AS size,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.size = b.size AND a.rid != b.rid
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracles() -> dict[str, str]:
    return {"op2_mixing": MIXING, "op5_fingerprints": FINGERPRINTS, "op8_chat": CHAT, "op9_archives": ARCHIVES, "op11_licenses": LICENSES, "op12_negatives": NEGATIVES}
