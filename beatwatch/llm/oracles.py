"""SQL checks of the training-text queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
sums AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place,
    coalesce(2.0::DOUBLE * sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE, 0.0) AS full_before
  FROM sources),
rates AS (SELECT *, (total - full_before) / w_left AS rate FROM sums),
chosen AS (SELECT arg_min(rate, place) AS rate FROM rates WHERE rate * w <= 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, CASE WHEN c.rate IS NULL THEN 2.0::DOUBLE * source_size ELSE least(c.rate * w, 2.0::DOUBLE * source_size) END AS target
  FROM rates, chosen c),
stepped AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 4294967296.0)::BIGINT ELSE 0 END AS step,
    ('0x' || substr(md5('mix-1' || chr(1) || source), 1, 8))::BIGINT AS start
  FROM targets),
placed AS (
  SELECT *, CASE WHEN size > 0 THEN floor(log2(size) * 8.0 + 1e-6)::INT ELSE -1 END AS class, ('0x' || substr(md5('mix-1' || doc_id::VARCHAR), 1, 8))::BIGINT AS spot FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, spot, doc_id, size) AS nth FROM placed)
SELECT r.doc_id, r.size, t.source_size, t.target,
  r.size * (((nth::HUGEINT * step + start) // 4294967296) - (((nth - 1)::HUGEINT * step + start) // 4294967296))::BIGINT AS taken, r.source,
  (((nth::HUGEINT * step + start) // 4294967296) - (((nth - 1)::HUGEINT * step + start) // 4294967296))::BIGINT AS copies
FROM ranked r JOIN stepped t ON r.source IS NOT DISTINCT FROM t.source
"""

_WORDS = r"""split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split)"""


def _windows(n: int, source: str = "w") -> str:
    """The n words from each place on, as one text, where there are so many."""
    return f"""SELECT doc_id, i, array_to_string(ws, ' ') AS gram FROM (
    SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS ws FROM {source}) WHERE len(ws) = {n}"""


def _covered(n: int) -> str:
    """Words, and characters of them, in n-grams that their text has twice."""
    return f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM ({_windows(n)})),
c{n} AS (SELECT doc_id, count(*) FILTER (hit) AS words_{n}, coalesce(sum(length(word)) FILTER (hit), 0)::BIGINT AS covered_{n} FROM (
  SELECT w.doc_id, w.word, coalesce(max(g.twice::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS hit
  FROM w LEFT JOIN g{n} g ON g.doc_id = w.doc_id AND g.i = w.i) GROUP BY doc_id)"""


_LIMITS = {5: 0.30, 6: 0.28, 8: 0.26, 10: 0.25}
_SHARES = " AND ".join(f"coalesce(covered_{n}, 0) <= {most}::DOUBLE * word_chars" for n, most in _LIMITS.items())
_QUALITY = rf"""
WITH {_WORDS}, {", ".join(_covered(n) for n in _LIMITS)},
chars AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM lines WHERE regexp_matches(line, '[^ 	-
]')),
dups AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[ 	-
]', '', 'g')))::BIGINT AS dup_line_chars FROM again WHERE dup GROUP BY doc_id),
found AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words_5, 0) AS n_repeat_words,
    coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(covered_{n}, 0) AS covered_{n}" for n in _LIMITS)}
  FROM documents d LEFT JOIN chars USING (doc_id) LEFT JOIN dups USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _LIMITS)})
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_SHARES} AND dup_line_chars <= 0.3::DOUBLE * word_chars AS kept FROM found
"""

_REPEATS = f"""
WITH {_WORDS}, win AS ({_windows(20)}),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS again FROM win),
marked AS (SELECT w.doc_id, w.i, w.word, coalesce(max(l.again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i),
left_over AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN left_over USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
sh AS (SELECT DISTINCT doc_id, gram FROM ({_windows(5)}) UNION SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared s JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * s.k >= 85 * (x.k + y.k - s.k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u AS a, v AS b FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(r.low, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
docs AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM split WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM split) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(total.docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (SELECT a.item_id, d.r, d.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * d.n * total.docs) // total.terms))))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN tf t USING (term) JOIN docs d USING (r), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op2_minhash_near_duplicates": _NEAR,
    "op3_mix_sources": _MIX,
    "op5_repetition_rules": _QUALITY,
    "op6_recompression_repeats": _REPEATS,
    "op13_block_max_search": _SEARCH,
}
