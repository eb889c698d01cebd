"""DuckDB SQL that gives the rows of those corpus queries that SQL can express."""

from __future__ import annotations

from partloom.llm import licenses, line_dups, mixing, quality, suffix_dedup

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _condition(text: str) -> str:
    return f"({text})"


def _votes() -> str:
    cases = [
        f"CASE WHEN {_condition(r.bad)} THEN -1 WHEN {_condition(r.good)} THEN 1 ELSE 0 END"
        for r in quality.RULES
    ]
    return "[" + ", ".join(cases) + "]"


def quality_sql() -> str:
    """Base counts by unnested windows; the estimation as a recursive fold over patterns."""
    rules = len(quality.RULES)
    known = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(quality.FUNCTION_WORDS)) + "]"
    least, most = quality.LEAST_SHARE, quality.MOST_SHARE

    def weighed(votes: str) -> str:
        return (
            f"list_sum(list_transform(range(1, {rules + 1}), lambda j: CASE WHEN {votes}[j] < 0 "
            f"THEN against[j] WHEN {votes}[j] > 0 THEN pro[j] ELSE 0.0 END))"
        )

    def weight(vote: int, limits: tuple[float, float]) -> str:
        def rate(q: str, mass: str) -> str:
            return (
                f"(list_sum(list_transform(posts, lambda p: CASE WHEN p.v[j] = {vote} THEN p.n "
                f"ELSE 0.0 END * {q})) + 0.5) / ({mass} + 1.5)"
            )

        return (
            f"list_transform(range(1, {rules + 1}), lambda j: greatest({limits[0]}, least("
            f"{limits[1]}, ln({rate('p.q', 'good')} / ({rate('(1 - p.q)', 'bad')})))))"
        )
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next_i - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i
        FROM starts WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_distinct(w)) AS n_distinct,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
    len(regexp_extract_all(text, '!')) AS n_bangs,
    len(list_intersect({known}, list_transform(w, lambda x: lower(x)))) AS n_function,
    len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless,
    len(list_filter(w, lambda x: right(x, 1) IN ('.', '?', '!'))) AS n_ends
  FROM t LEFT JOIN covered USING (doc_id)),
voted AS (SELECT *, {_votes()} AS votes FROM m),
counted AS (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes),
patterns AS (
  SELECT list({{'v': votes, 'n': n}} ORDER BY votes) AS ps, sum(n) AS total FROM counted),
model AS (
  SELECT 0 AS round, {quality.START_BIAS}::DOUBLE AS bias,
    list_transform(range({rules}), lambda i: {quality.START_AGAINST}::DOUBLE) AS against,
    list_transform(range({rules}), lambda i: {quality.START_FOR}::DOUBLE) AS pro
  UNION ALL
  SELECT round + 1, ln(share / (1 - share)), against, pro
  FROM (
    SELECT round, greatest({least}, least({most}, good / total)) AS share,
      {weight(-1, quality.AGAINST)} AS against,
      {weight(1, quality.FOR)} AS pro
    FROM (
      SELECT *, list_sum(list_transform(posts, lambda p: p.n * p.q)) AS good,
        list_sum(list_transform(posts, lambda p: p.n * (1 - p.q))) AS bad
      FROM (
        SELECT round, total, list_transform(ps, lambda p: {{'v': p.v, 'n': p.n,
          'q': 1 / (1 + exp(-(bias + {weighed('p.v')})))}}) AS posts
        FROM model, patterns WHERE round < {quality.ROUNDS})))),
judged AS (
  SELECT voted.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    round(1 / (1 + exp(-(bias + {weighed('votes')}))), 6) AS posterior
  FROM voted, (SELECT * FROM model WHERE round = {quality.ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= 0.5 AS kept, posterior
FROM judged"""


NEAR_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, i, i + 2) END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached AS (
  SELECT doc_id, doc_id AS other FROM t
  UNION
  SELECT reached.doc_id, b FROM reached JOIN links ON a = other),
component AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def license_sql() -> str:
    """Every unit against every template, without size bounds."""
    known = ",\n".join(
        f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')"
        for i, (name, text) in enumerate(licenses.TEMPLATES)
    )
    words = f"regexp_extract_all(lower(text), '{licenses.NORMAL_WORD}')"
    return rf"""
WITH known(number, name, text) AS (VALUES {known}),
lines AS (
  SELECT doc_id, 'line' AS kind, i AS unit, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
blocks AS (
  SELECT DISTINCT doc_id, 'block' AS kind, 0 AS unit, text
  FROM (SELECT doc_id, unnest(list_append(
          regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\r]*\n\s*'),
          coalesce(text, ''))) AS text FROM documents)
  WHERE contains(text, chr(10))),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM blocks),
grams AS (
  SELECT DISTINCT doc_id, kind, unit, text, w[i] AS a, w[i + 1] AS b
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (SELECT *, {words} AS w FROM units))),
template_grams AS (
  SELECT DISTINCT number, name, w[i] AS a, w[i + 1] AS b
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (SELECT *, {words} AS w FROM known))),
sizes AS (
  SELECT doc_id, kind, unit, text, count(*) AS n FROM grams GROUP BY doc_id, kind, unit, text),
template_sizes AS (SELECT number, name, count(*) AS n FROM template_grams GROUP BY number, name),
met AS (
  SELECT doc_id, kind, unit, text, number, name, count(*) AS shared
  FROM grams JOIN template_grams USING (a, b) GROUP BY ALL),
matches AS (
  SELECT met.doc_id, met.kind, met.unit, met.number, met.name,
    2.0::DOUBLE * shared / (s.n + k.n) AS score
  FROM met JOIN sizes s USING (doc_id, kind, unit, text) JOIN template_sizes k USING (number)
  WHERE 2.0::DOUBLE * shared / (s.n + k.n) >= {licenses.LEAST}),
per_document AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
    max_by(name, {{'s': score, 'n': -number}}) AS best_license,
    round(max(score), 6) AS best_score,
    count(DISTINCT {{'u': unit, 'n': name}}) FILTER (kind = 'line') AS n_matches
  FROM matches GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, best_score,
  coalesce(n_matches, 0) AS n_matches
FROM documents LEFT JOIN per_document USING (doc_id)"""


LINES_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, regexp_replace(l[i], '^{SPACE}+|{SPACE}+$', '', 'g') AS bare
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE bare <> ''),
windows AS (
  SELECT doc_id, k, list(bare) OVER w AS content, list(i) OVER w AS numbers
  FROM full_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY k
               ROWS BETWEEN CURRENT ROW AND {line_dups.WINDOW - 1} FOLLOWING)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS nth
  FROM windows WHERE len(numbers) = {line_dups.WINDOW}),
gone AS (SELECT DISTINCT doc_id, unnest(numbers) AS i FROM placed WHERE nth > 1),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS text,
    count(gone.i) AS n_removed
  FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM full_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(kept.text) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)"""


_L = suffix_dedup.LENGTH
REPEATS_SQL = f"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (
  SELECT doc_id, base, substr(x, 2 * base + 1, {2 * (500 + _L - 1)}) AS x
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {_L - 1}, 500)) AS base FROM raw)),
windows AS (
  SELECT doc_id, base + o AS s, row_number() OVER (PARTITION BY substr(x, 2 * o + 1, {2 * _L})
                                                 ORDER BY doc_id, base + o) AS nth
  FROM (SELECT doc_id, base, x, unnest(range(0, length(x) // 2 - {_L - 1})) AS o FROM blocks)),
later AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before
  FROM windows WHERE nth > 1),
numbered AS (
  SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + {_L} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM later),
spans AS (
  SELECT doc_id, run, min(s) AS a, max(s) + {_L} AS b FROM numbered GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_here
  FROM spans),
pieces AS (
  SELECT doc_id, string_agg(substr(x, 2 * from_here + 1, 2 * (a - from_here)), '' ORDER BY a) AS h,
    max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM cuts JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(h, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM raw LEFT JOIN pieces USING (doc_id)"""


def contamination_sql(width: int = 10) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH items AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + {width - 1}) AS content
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i
        FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
sizes AS (SELECT DISTINCT len(content) AS n FROM windows),
places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS content
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (content)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
per_document AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN per_document USING (doc_id)"""


def mixing_sql(weights: tuple[int, ...] = mixing.WEIGHTS, repeats: int = mixing.REPEATS) -> str:
    """The same queue by windows over whole tables."""
    count = len(weights)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT *, {list(weights)}[(number % {count}) + 1]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS total,
          row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
        FROM sized GROUP BY source)),
filled AS (
  SELECT *, coalesce(sum({repeats} * total) OVER w, 0)::BIGINT AS full_words,
    coalesce(sum(weight) OVER w, 0)::BIGINT AS full_weight
  FROM sources
  WINDOW w AS (ORDER BY ({repeats} * total)::DOUBLE / weight, number
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
budget AS (SELECT coalesce(sum(total), 0)::BIGINT AS words, sum(weight)::BIGINT AS weights FROM sources),
level AS (
  SELECT max((words - full_words)::DOUBLE / (weights - full_weight)) AS level FROM filled, budget),
targets AS (
  SELECT source, total, number, least(({repeats} * total)::DOUBLE, level * weight) AS target
  FROM sources, level),
placed AS (
  SELECT s.doc_id, s.size, t.number, t.total, t.target, row_number() OVER () AS id,
    sum(s.size) OVER (PARTITION BY t.number ORDER BY s.draw, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS reach
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT id, size, number, copy, reach, (copy * total + reach)::DOUBLE / target AS finish
  FROM placed, (SELECT unnest(range({repeats})) AS copy) WHERE size > 0),
summed AS (
  SELECT id, size, sum(size) OVER (ORDER BY finish, number, copy, reach
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM queue),
uses AS (
  SELECT id, sum(greatest(0, least(size, words - (upto - size))))::BIGINT AS taken
  FROM summed, budget GROUP BY id)
SELECT doc_id, size, total AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN uses USING (id)"""


def search_sql(top: int = 10) -> str:
    """Every document scored for every item."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower}, '{word}') AS w
  FROM documents),
sizes AS (
  SELECT id, doc_id, len(w)::BIGINT AS n, count(*) FILTER (len(w) > 0) OVER () AS docs,
    (sum(len(w)) OVER ())::BIGINT AS terms FROM docs),
tf AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT item, item_id, term, count(*) AS qf
  FROM (SELECT row_number() OVER () AS item, item_id,
          unnest(regexp_extract_all({lower}, '{word}')) AS term FROM benchmark)
  GROUP BY item, item_id, term),
scored AS (
  SELECT item, item_id, id, doc_id,
    sum(qf * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT
      AS score
  FROM wanted JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (id)
  GROUP BY item, item_id, id, doc_id),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {top}"""


def trie_sql(every: int = 20, choices: int = 4) -> str:
    """Nodes as groups of prefixes; subtrees by the prefixes of every node."""
    # The checksum of a decimal number, bit by bit; the constant is the reversed polynomial.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)),
      4294967295::BIGINT)"""
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS turns
  FROM (SELECT conv_id, turn, sha256(strlen(role)::VARCHAR || ':' || role || text) AS k,
          len(regexp_extract_all(text, '{WORD}'))::BIGINT AS w FROM turns) GROUP BY conv_id),
cut AS (SELECT conv_id, turns, {crc} % {choices} AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM own)),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []),
    coalesce(list_slice(c.turns, c.h + 1, len(c.turns)), [])) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {every}),
prefixes AS (
  SELECT conv_id, d, list_slice(ks, 1, d) AS prefix, d = len(ks) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d
        FROM (SELECT *, list_transform(turns, lambda t: t.k) AS ks FROM rebuilt))),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM prefixes GROUP BY prefix, d),
children AS (
  SELECT list_slice(prefix, 1, d - 1) AS prefix, d - 1 AS d, count(*) AS n
  FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (prefix, d)),
above AS (
  SELECT list_slice(prefix, 1, a) AS prefix, a AS d, sum((n_convs - 1) * w)::BIGINT AS saved,
    count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
  a.leaves AS n_leaves, a.saved AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN above a USING (prefix, d)
LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.prefix = list_slice(c.prefix, 1, c.d - 1)"""
