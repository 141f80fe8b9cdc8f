"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from pulsecheck.llm.common import words_of
from pulsecheck.llm.licenses import BASE, TEMPLATES
from pulsecheck.llm.secrets import BAR, CODES, FIRST, RANDOM, SAMPLE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')"


DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {words('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
places AS (SELECT item, w, least(13, len(w)) AS size, unnest(range(0, greatest(1, len(w) - 12))) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[p + 1:p + size], ' ') AS g FROM places),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT r, p, s.size, item FROM (SELECT r, p, size, array_to_string(w[p + 1:p + size], ' ') AS g FROM starts) s
  JOIN windows USING (size, g)),
hits AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS at FROM (SELECT DISTINCT r, p, size FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)"""


def _license_scan() -> str:
    templates, template_words, key_words = [], [], []
    for t, template in enumerate([*BASE, *TEMPLATES]):
        own, key = ([w.decode() for w in words_of(x.encode())] for x in (template.text, template.key))
        first = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        templates.append(f"({t}, '{template.label}', {template.share}, {len(key)}, {str(t < len(BASE)).lower()})")
        template_words += [f"({t}, {i}, '{w}')" for i, w in enumerate(own)]
        key_words += [f"({t}, {first + i}, '{w}')" for i, w in enumerate(key)]
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {words('text')} AS w FROM documents),
templates(t, label, share, n_key, base) AS (VALUES {', '.join(templates)}),
template_words(t, place, word) AS (VALUES {', '.join(template_words)}),
key_words(t, place, word) AS (VALUES {', '.join(key_words)}),
vocabulary AS (SELECT DISTINCT word FROM template_words),
doc_words AS (SELECT * FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS spot FROM docs) SEMI JOIN vocabulary USING (word)),
rarity AS (SELECT word, ln(((SELECT count(*) FROM docs) + 1) / (count(DISTINCT r) + 1)) + 1 AS x
  FROM vocabulary LEFT JOIN doc_words USING (word) GROUP BY word),
totals AS (SELECT t, sum(x) AS total FROM template_words JOIN rarity USING (word) GROUP BY t),
keyed AS (SELECT r, t, spot - place AS start FROM doc_words JOIN key_words USING (word) JOIN templates USING (t)
  GROUP BY r, t, spot - place, n_key HAVING count(*) = n_key),
weighed AS (SELECT r, t, start, sum(x) AS same FROM keyed JOIN template_words USING (t)
  JOIN doc_words USING (r, word) JOIN rarity USING (word) WHERE spot = start + place GROUP BY r, t, start),
found AS (SELECT r, label, base, start, least(1, same / total) AS score FROM weighed JOIN totals USING (t) JOIN templates USING (t)
  WHERE same >= share * total * (1 - 1e-12)),
by_doc AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score FROM docs LEFT JOIN by_doc USING (r)"""


ASSIGN = """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
LONG, ANY = "[A-Za-z0-9+/_=-]{20,}", "[A-Za-z0-9+/_=-]{4,}"


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind from the texts between them: the start of the n-th is all that lies before it."""
    return f"""SELECT r, {kind} AS kind, before + gap_chars AS start, before + gap_chars + length(m) AS stop, m FROM (
      SELECT r, m, counted, length(gap) AS gap_chars,
        sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(gap) - length(m) AS before FROM (
        SELECT r, unnest(ms) AS m, unnest(cs) AS counted, unnest(gaps[:len(ms)]) AS gap, unnest(range(0, len(ms))) AS i FROM (
          SELECT r, regexp_extract_all(x, '{pattern}') AS ms, regexp_extract_all(x, '{pattern}', {group}) AS cs,
            string_split_regex(x, '{pattern}') AS gaps FROM docs) WHERE len(ms) > 0)) WHERE length(counted) >= {least}"""


def _secret_scan() -> str:
    pairs = f"""SELECT label, a, b, count(*) AS n FROM (
      SELECT label, unnest(list_concat([{CODES}], codes[:len(codes) - 1])) AS a, unnest(codes) AS b FROM (
        SELECT label, [ascii(c) - {FIRST} for c in string_split(token, '')] AS codes FROM tokens)) GROUP BY label, a, b"""
    plain = "x"
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = f"regexp_replace({plain}, '{pattern}', ' ', 'g')"
    digest = "sha256(CAST(i AS VARCHAR))"
    code64 = f"to_base64(unhex({digest}))"
    names = "['assign', 'access', 'hex', 'markov'][kind + 1]"

    def smooth(n: str, total: str) -> str:
        return f"ln((coalesce({n}, 0) + 0.5::DOUBLE) / (coalesce({total}, 0) + {0.5 * CODES}::DOUBLE))"

    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x FROM documents),
chosen AS (SELECT DISTINCT x FROM docs WHERE md5(x) <= (SELECT max(h) FROM (SELECT DISTINCT md5(x) AS h FROM docs ORDER BY h LIMIT {SAMPLE}))),
tokens AS (
  SELECT 1 AS label, unnest([md5(CAST(i AS VARCHAR)), sha1(CAST(i AS VARCHAR)), upper({digest}), {code64}, upper({code64})[1:20], {code64}[1:32]]) AS token
  FROM range({RANDOM}) t(i)
  UNION ALL SELECT DISTINCT 0, unnest(regexp_extract_all({plain}, '{ANY}')) FROM chosen),
pairs AS ({pairs}),
sums AS (SELECT label, a, sum(n) AS n FROM pairs GROUP BY label, a),
weights AS (SELECT g.a, h.b, round({smooth('r1.n', 's1.n')} - {smooth('r0.n', 's0.n')}, 9) AS w FROM range({CODES + 1}) g(a), range({CODES}) h(b)
  LEFT JOIN pairs r1 ON r1.label = 1 AND r1.a = g.a AND r1.b = h.b LEFT JOIN pairs r0 ON r0.label = 0 AND r0.a = g.a AND r0.b = h.b
  LEFT JOIN sums s1 ON s1.label = 1 AND s1.a = g.a LEFT JOIN sums s0 ON s0.label = 0 AND s0.a = g.a),
base AS ({_spans(0, ASSIGN, 2, 8)} UNION ALL {_spans(1, ACCESS, 0, 16)} UNION ALL {_spans(2, HEX, 0, 32)}),
candidates AS (SELECT c.* FROM ({_spans(3, LONG, 0, 0)}) c WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
judged AS (SELECT r, kind, start, stop, m FROM (
    SELECT r, kind, start, stop, m, unnest(list_concat([{CODES}], codes[:len(codes) - 1])) AS a, unnest(codes) AS b FROM (
      SELECT *, [ascii(c) - {FIRST} for c in string_split(m, '')] AS codes FROM candidates)) JOIN weights USING (a, b)
  GROUP BY r, kind, start, stop, m HAVING sum(w) >= {BAR}),
told AS (SELECT r, kind, start, {names} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s
  FROM (SELECT r, kind, start, stop FROM base UNION ALL SELECT r, kind, start, stop FROM judged)),
by_doc AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN by_doc USING (r)"""


# The pages of the tables have one article each, of headings and paragraphs; references in them are &amp; and &quot;, some cut off.
BLOCK_ENDS = r"</?(article|h1|p)>"
MAIN_TEXT = f"""
WITH pieces AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(replace(
  regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' '), '</?b>', '', 'g'), '{BLOCK_ENDS}', chr(1), 'g'), chr(1)) AS parts FROM pages),
clean AS (SELECT page_id, url, [trim(regexp_replace(replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', chr(2), 'g'), chr(2), '&'),
  '[\\s\\x{{A0}}]+', ' ', 'g')) FOR x IN parts] AS lines FROM pieces),
texts AS (SELECT page_id, url, array_to_string([x FOR x IN lines IF x <> ''], chr(10)) AS text FROM clean)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts"""

HARD_NEGATIVES = """
WITH whole AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5"""

ORACLE = {
    "op1_license_scan": _license_scan(),
    "op2_decontamination": DECONTAMINATION,
    "op5_secret_scan": _secret_scan(),
    "op11_main_text": MAIN_TEXT,
    "op13_hard_negatives": HARD_NEGATIVES,
}
