"""SQL twins of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

# crc32 of the decimal id: of each byte the exclusive or, then eight shifts; the constant is the reflected polynomial
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda ch: list_concat([ascii(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

TURN_TRIE = f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
counted AS (SELECT conv_id, l, {CRC32} % 6 AS h FROM own),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
    FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
hashed AS (SELECT conv_id, l, list_transform(l, lambda x: md5(x.r) || md5(x.t)) AS k FROM rebuilt),
prefixes AS (
    SELECT conv_id, d, len(l) AS m, array_to_string(k[1:d], ',') AS p, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], ',') END AS up,
        CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS chars
    FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM hashed)),
nodes AS (
    SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (m = d), '')) AS ends
    FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS children FROM nodes WHERE d > 0 GROUP BY d, up),
full_nodes AS (SELECT n.*, coalesce(k.children, 0) AS children FROM nodes n LEFT JOIN kids k USING (d, p)),
below AS (
    SELECT DISTINCT a.d, a.p, b.d AS bd, b.p AS bp FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
    SELECT s.d, s.p, count(*) FILTER (n.children = 0) AS leaves, sum((n.n - 1) * n.chars) AS saved
    FROM below s JOIN full_nodes n ON n.d = s.bd AND n.p = s.bp GROUP BY s.d, s.p)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, n.children::BIGINT AS n_children,
    s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s USING (d, p) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.up
"""

WORD = r"[^\x20\x09-\x0D]+"
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "repeated_lines": "10 * n_dup_lines > n_words",
}
_failed = ", ".join(f"sum(({rule})::INT)::DOUBLE AS f_{name}" for name, rule in RULES.items())
# by moments: mean m, and g, the share of the variance that is between hosts; the prior is worth 1 / g - 1 rows
_moments = ", ".join(f"sum(f_{n}) / sum(n) AS m_{n}, sum(f_{n} * f_{n} / n) - sum(f_{n}) * sum(f_{n}) / sum(n) AS s_{n}" for n in RULES)
_between = ", ".join(
    f"CASE WHEN hosts < 2 OR m_{n} * (1 - m_{n}) <= 0 OR spare <= 0 THEN 0 "
    f"ELSE (s_{n} - m_{n} * (1 - m_{n}) * (hosts - 1)) / (m_{n} * (1 - m_{n}) * spare) END AS g_{n}"
    for n in RULES
)
_rejected = " OR ".join(
    f"(g_{n} > 0 AND (f_{n} + (1 / least(g_{n}, 1) - 1) * m_{n}) / (n + (1 / least(g_{n}, 1) - 1)) > 0.5)" for n in RULES
)

HOST_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT i, w, generate_subscripts(w, 1) AS pos FROM (SELECT i, regexp_extract_all(text, '{WORD}') AS w FROM docs)),
windows AS (
    SELECT i, pos, count(*) OVER (PARTITION BY i, w[pos], w[pos + 1], w[pos + 2]) AS n FROM words WHERE pos + 2 <= len(w)),
covered AS (SELECT i, count(DISTINCT pos + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY i),
lines AS (
    SELECT i, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM docs),
measures AS (
    SELECT d.doc_id, d.source, len(regexp_extract_all(d.text, '{WORD}'))::BIGINT AS n_words,
        length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs d JOIN lines l USING (i) LEFT JOIN covered c USING (i)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {_failed} FROM measures WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT count(*) AS hosts, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spare, {_moments} FROM hosts),
betweens AS (SELECT *, {_between} FROM moments),
rejected AS (SELECT source FROM hosts, betweens WHERE {_rejected})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ({RULES["few_words"]} OR {RULES["repeated_words"]}) AS base_failed,
    NOT ({RULES["few_words"]} OR {RULES["repeated_words"]}) AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM measures
"""

TOP_K = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def _spans(turns: str) -> str:
    """Code point ranges of the assistant's texts in a rendered list of turns."""
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda u: 14 + length(u.r) + length(u.t))), 0)::BIGINT + 5 + length({turns}[i].r)"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].r = 'assistant'), "
        f"lambda i: ({before}) || '-' || ({before} + length({turns}[i].t))), ',')"
    )


def _rendered(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda u: '<|' || u.r || '|>' || chr(10) || u.t || chr(10) || '<|end|>' || chr(10)), '')"


PREFERENCES = f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
answered AS (
    SELECT conv_id, l[1:n] AS a, l[n] AS answer FROM (
        SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda i: l[i].r = 'assistant')) AS n FROM own) WHERE n IS NOT NULL),
pairs AS (
    SELECT c.conv_id, o.conv_id AS other_id, c.a, list_concat(c.a[1:len(c.a) - 1], CASE WHEN o.conv_id IS NULL THEN [] ELSE [o.answer] END) AS b
    FROM answered c LEFT JOIN answered o ON o.conv_id = xor(c.conv_id, 1)),
common AS (
    SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM pairs),
rest AS (SELECT *, a[1:n] AS p, a[n + 1:] AS x, b[n + 1:] AS y FROM common)
SELECT conv_id, other_id, n::BIGINT AS n_common, {_rendered("p")} AS prompt, {_rendered("x")} AS chosen, {_rendered("y")} AS rejected,
    {_spans("x")} AS chosen_mask, {_spans("y")} AS rejected_mask
FROM rest
"""

ORACLES = {"op3_top_k": TOP_K, "op7_preferences": PREFERENCES, "op11_turn_trie": TURN_TRIE, "op12_host_rules": HOST_RULES}
