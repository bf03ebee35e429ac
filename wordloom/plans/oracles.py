"""The registered queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from wordloom.plans.catalog import SIZE

ORACLES: dict[str, str] = {}


# -- pieces ----------------------------------------------------------------------------


def norm(text: str) -> str:
    folded = f"lower(strip_accents({text}))"
    plain = rf"regexp_replace({folded}, '[^\P{{C}}\n\t\r]', '', 'g')"
    return rf"regexp_replace({plain}, '[\s\p{{Z}}]', ' ', 'g')"


def tokens(text: str) -> str:
    punct, word = r"\p{P}!-/:-@\[-`{-~", r"\p{L}\p{M}\p{Nd}\p{Nl}"
    return rf"regexp_extract_all({norm(text)}, '[{punct}]|[{word}]+|[^\s\p{{Z}}{punct}{word}]+')"


def plain_sentences(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


def state(seed: str, *parts: str) -> str:
    key = ", ".join(["'" + seed + "'", *[f"({p})::VARCHAR" for p in parts]])
    return f"((('0x' || substr(md5(concat_ws(':', {key})), 1, 8))::BIGINT) % 2147483647)"


def digest(seed: str, *parts: str) -> str:
    key = ", ".join(["'" + seed + "'", *[f"({p})::VARCHAR" for p in parts]])
    return f"md5(concat_ws(':', {key}))"


def uniform(s: str, pos: str) -> str:
    a = f"((({s}) + ({pos}) * 1000003) % 2147483647 * 48271 % 2147483647)"
    b = f"(xor({a}, {a} >> 13) * 69621 % 2147483647)"
    c = f"(xor({b}, {b} >> 16) * 39373 % 2147483647)"
    return f"({c} / 2147483647.0::DOUBLE)"


DOCS = f"docs AS MATERIALIZED (SELECT doc_id AS record_id, text, lang, {tokens('text')} AS tok FROM documents)"
TURNS = (
    f"turns AS MATERIALIZED (SELECT conv_id * 1000 + turn AS record_id, text, {tokens('text')} AS tok FROM conversations)"
)
BENCH = f"bench AS MATERIALIZED (SELECT item_id AS record_id, text, {tokens('text')} AS tok FROM benchmark)"


def count(source: str, name: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT unnest(tok) AS word FROM {source}) GROUP BY word)"
    )


def vocab(counts: str = "counts", size: int = SIZE, min_freq: int = 3, specials: str = "'<UNK>','<S>','</S>'") -> str:
    n = specials.count(",") + 1
    return f"""vocab AS MATERIALIZED (
      SELECT (i - 1)::INT AS id, (list_value({specials}))[i] AS word, NULL::BIGINT AS cnt,
             TRUE AS is_special, FALSE AS is_infrequent
      FROM range(1, {n + 1}) t(i)
      UNION ALL
      SELECT (r - 1 + {n})::INT, word, cnt, FALSE, cnt < {min_freq}
      FROM (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS r
            FROM {counts} WHERE word NOT IN ({specials}))
      WHERE r <= {size} - {n})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


COUNTS = [DOCS, count("docs", "counts")]
VOCAB = [*COUNTS, vocab()]
VOCAB_COLUMNS = "SELECT id, word, cnt, is_special, is_infrequent FROM vocab"
WORDS2 = [TURNS, count("turns", "counts2"), "words2 AS (SELECT word FROM counts2)"]


def encoded(source: str = "docs", name: str = "enc") -> str:
    """Long form: (record_id, pos, id, token) with the wrapping tokens."""
    return f"""{name}_rows AS MATERIALIZED (
      SELECT t.record_id, t.pos, coalesce(v.id, 0) AS id, coalesce(v.word, '<UNK>') AS token
      FROM (SELECT record_id, unnest(tok) AS word, generate_subscripts(tok, 1) AS pos FROM {source}) t
      LEFT JOIN (SELECT * FROM vocab WHERE NOT is_infrequent) v ON t.word = v.word
      UNION ALL SELECT record_id, 0, 1, '<S>' FROM {source}
      UNION ALL SELECT record_id, len(tok) + 1, 2, '</S>' FROM {source}),
    {name} AS MATERIALIZED (
      SELECT record_id, list(id ORDER BY pos) AS ids, list(token ORDER BY pos) AS tokens
      FROM {name}_rows GROUP BY record_id)"""


ENC = [*VOCAB, encoded()]

WEIGHTS = f"""weights AS MATERIALIZED (
  SELECT word, cnt, (sqrt(f / 1e-4) + 1) * 1e-4 / f AS keep_prob
  FROM (SELECT word, cnt, cnt::DOUBLE / sum(cnt) OVER () AS f
        FROM (SELECT word, cnt FROM counts ORDER BY cnt DESC, word LIMIT {SIZE})))"""

# sequences: long enough, thinned
THIN = [
    *ENC,
    WEIGHTS,
    f"""cut AS (SELECT record_id, ids FROM enc WHERE len(ids) >= 9),
    thin_rows AS (SELECT record_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM cut),
    thin AS MATERIALIZED (
      SELECT record_id, list(id ORDER BY pos) AS ids FROM (
        SELECT r.*, coalesce(w.keep_prob, 1.0) AS p, {uniform(state('1337', 'record_id'), 'pos')} AS u
        FROM thin_rows r JOIN vocab v ON r.id = v.id LEFT JOIN weights w ON v.word = w.word)
      WHERE p > u GROUP BY record_id)""",
]

LOSSES = """losses AS (
  SELECT event_type AS run, CASE WHEN user_id % 4 = 0 THEN 'val' ELSE 'train' END AS phase,
         date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS epoch, event_id::INT AS step, value AS loss
  FROM events)"""
COMPONENTS = """x AS (
  SELECT vec_id::INT AS id, label, (generate_subscripts(embedding, 1) - 1)::INT AS pos,
         unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def describe(source: str, value: str) -> str:
    v = f"({value})::DOUBLE"
    return f"""SELECT count(*) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
      round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50,
      round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM {source}"""


def rule_sentences(text: str, source: str) -> list[str]:
    """Sentences by the rules, decided between neighbouring runs of non-space."""
    return [
        f"""runs AS (
      SELECT record_id, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (
        SELECT record_id, list_filter(string_split({norm(text)}, ' '), lambda s: s <> '') AS r FROM {source})),
    breaks AS (
      SELECT record_id, i, run, CASE
        WHEN regexp_matches(run, '[?!]$') THEN 1
        WHEN regexp_matches(run, '[?!.]["'')\\]]$') THEN 1
        WHEN regexp_matches(run, '\\.$') AND NOT regexp_matches(run, '\\.\\.$') AND
             NOT regexp_matches(run, '(^|[("''])[a-z]\\.$') AND NOT regexp_matches(run, '[0-9]\\.$') THEN 1
        WHEN regexp_matches(run, '\\.$') AND NOT regexp_matches(run, '\\.\\.$') AND
             regexp_matches(lead(run) OVER w, '^[^a-z]') THEN 1
        ELSE 0 END AS ends
      FROM runs WINDOW w AS (PARTITION BY record_id ORDER BY i)),
    numbered AS (
      SELECT record_id, i, run, coalesce(sum(ends) OVER (
        PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_no
      FROM breaks),
    sentences AS (
      SELECT record_id, sent_no, string_agg(run, ' ' ORDER BY i) AS text FROM numbered GROUP BY record_id, sent_no)"""
    ]


PLAIN_SENTENCES = f"""SELECT record_id, (generate_subscripts(s, 1) - 1)::INT AS sent_no, unnest(s) AS text FROM (
  SELECT doc_id AS record_id, {plain_sentences(norm('text'))} AS s FROM documents)"""

# -- sources and sinks -----------------------------------------------------------------

ORACLES["load_corpus"] = "SELECT doc_id AS record_id, text FROM documents"
ORACLES["corpus_registry"] = """
SELECT CASE lang WHEN 'en' THEN 'bookcorpus' WHEN 'fr' THEN 'wikipedia' ELSE 'commoncrawl' END AS corpus,
       count(*) AS n_records FROM documents GROUP BY 1"""
ORACLES["prepare_corpus"] = PLAIN_SENTENCES
ORACLES["save_shards"] = "SELECT 32::BIGINT AS n_files, count(*) AS n_records FROM documents"
ORACLES["count_records"] = f"""
SELECT 'before' AS stage, count(*) AS n_records FROM documents
UNION ALL SELECT 'after', count(*) FROM ({PLAIN_SENTENCES})"""
ORACLES["save_load_vocabulary"] = with_(*VOCAB) + VOCAB_COLUMNS
ORACLES["merge_vocabularies"] = (
    with_(
        DOCS, TURNS, BENCH, count("docs", "c1"), count("turns", "c2"), count("bench", "c3"),
        """counts AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM (
             SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) WHERE cnt > 1 GROUP BY word)""",
        vocab(min_freq=5),
    )
    + VOCAB_COLUMNS
)
ORACLES["log_metrics"] = with_(LOSSES) + "SELECT run, phase, epoch, step, loss FROM losses WHERE step % 25 = 24"
ORACLES["loss_history"] = with_(LOSSES) + """
SELECT run, phase, (row_number() OVER (PARTITION BY run, phase ORDER BY epoch) - 1)::INT AS epoch_no, round(loss + 1e-11, 9) AS loss
FROM (SELECT run, phase, epoch, avg(loss) AS loss FROM losses GROUP BY run, phase, epoch)"""

# -- projection, filters, reshaping ----------------------------------------------------

ORACLES["map_records"] = with_(TURNS) + """
SELECT record_id, (generate_subscripts(tok, 1) - 1)::INT AS pos, unnest(tok) AS text FROM turns"""
ORACLES["flatten_nested"] = """
WITH items AS (
  SELECT record_id, unnest(i) AS item, generate_subscripts(i, 1) - 1 AS item_no FROM (
    SELECT doc_id AS record_id,
           flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))) AS i FROM documents))
SELECT record_id, count(*) AS n_items, max(item_no)::INT AS last, sum(length(item) * item_no)::BIGINT AS weighed
FROM items GROUP BY record_id"""
ORACLES["drop_hapax"] = with_(*COUNTS) + "SELECT word, cnt FROM counts WHERE cnt > 1"
ORACLES["infrequent_words"] = with_(*COUNTS) + "SELECT word, cnt FROM counts WHERE cnt < 3"
ORACLES["fitting_records"] = with_(*ENC) + """
SELECT record_id, len(ids)::INT AS n_ids, array_to_string(list_slice(ids, 1, 256), ' ') AS ids FROM enc WHERE len(ids) >= 9"""

PUNCT = "list_value(" + ",".join("'" + ("''" if c == "'" else c) + "'" for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ")"


def grams(n: int, source: str, members: str) -> str:
    """(record_id, pos, word) of n-grams over member words."""
    items = [f"lead(word, {i}) OVER w AS w{i}" if i else "word AS w0" for i in range(n)]
    test = " AND ".join(
        f"w{i} IS NOT NULL AND NOT list_contains({PUNCT}, w{i}) AND w{i} IN (SELECT word FROM {members})" for i in range(n)
    )
    text = " || ' ' || ".join(f"w{i}" for i in range(n))
    return f"""SELECT record_id, pos, {text} AS word FROM (
      SELECT record_id, pos, {', '.join(items)} FROM (
        SELECT record_id, (generate_subscripts(tok, 1) - 1)::INT AS pos, unnest(tok) AS word FROM {source})
      WINDOW w AS (PARTITION BY record_id ORDER BY pos)) WHERE {test}"""


ORACLES["member_bigrams"] = with_(*VOCAB, TURNS) + grams(2, "turns", "vocab")
ORACLES["member_trigrams"] = with_(*VOCAB, TURNS) + grams(3, "turns", "vocab")
ORACLES["mask_tokens"] = with_(DOCS) + """
SELECT record_id, array_to_string(list_filter(tok, lambda w: length(w) > 3), ' ') AS tokens FROM docs"""

# -- text ------------------------------------------------------------------------------

MARK = """CASE doc_id % 4 WHEN 0 THEN chr(7) WHEN 1 THEN chr(8203) || chr(9)
  WHEN 2 THEN chr(8232) || chr(13) ELSE chr(160) END"""
CONTROLS = f"""controls AS (
  SELECT doc_id AS record_id, mark || replace(text, chr(10), chr(10) || mark) AS text
  FROM (SELECT doc_id, text, {MARK} AS mark FROM documents))"""
ORACLES["prenormalize"] = with_(CONTROLS) + r"""
SELECT record_id, regexp_replace(text, '[^\P{C}\n\t\r]', chr(10), 'g') AS text FROM controls"""
ORACLES["decompose"] = """
SELECT doc_id AS record_id,
  (length(text) + len(regexp_extract_all(text, '[éèíçóöüêñäÉÈÍÇÓÖÜÊÑÄàâîïôûùÀÂÎÏÔÛÙáúÁÚ]')))::INT AS n_chars FROM documents"""
ORACLES["strip_accents"] = "SELECT doc_id AS record_id, strip_accents(text) AS text FROM documents"
ORACLES["lowercase"] = "SELECT doc_id AS record_id, lower(text) AS text FROM documents"
ORACLES["drop_control"] = with_(CONTROLS) + r"""
SELECT record_id, regexp_replace(text, '[^\P{C}\n\t\r]', '', 'g') AS text FROM controls"""
ORACLES["blank_whitespace"] = with_(CONTROLS) + r"""
SELECT record_id, regexp_replace(text, '[\s\p{Z}]', ' ', 'g') AS text FROM controls"""
ORACLES["normalize_text"] = f"SELECT doc_id AS record_id, {norm('text')} AS text FROM documents"
RULES = rule_sentences("text", "(SELECT doc_id AS record_id, text FROM documents)")
ORACLES["refuse_overwrite"] = f"""
SELECT count(*) AS n_records, sum(length({norm('text')}))::BIGINT AS n_chars, 1 AS refused FROM documents"""
ORACLES["split_sentences"] = with_(*RULES) + "SELECT record_id, sent_no, text FROM sentences"
ORACLES["split_sentences_plain"] = PLAIN_SENTENCES
ORACLES["split_sentences_model"] = PLAIN_SENTENCES
ORACLES["split_words"] = with_(DOCS) + "SELECT record_id, array_to_string(tok, ' ') AS words FROM docs"

HEADS = ["See also", "Notes", "FootNotes", "References", "Further reading", "Works Cited"]
CASES = " ".join(
    f"WHEN {i} THEN text || chr(10) || '{head}' || {'chr(13)' if i % 2 else chr(39) + ' ' + chr(39)} || chr(10) || tail"
    for i, head in enumerate(HEADS)
)
ARTICLES = f"""articles AS (
  SELECT doc_id AS record_id, CASE doc_id % 7 {CASES} ELSE text END AS text FROM (
    SELECT doc_id, text, ' ' || chr(10) || 'First' || chr(10) || 'External links ' || chr(10) || text AS tail
    FROM documents))"""


def body(text: str) -> str:
    order = [
        "Gallery", "See [Aa]lso", "Notes and [Rr]eferences", "Notes", "Endnotes", "Foot[Nn]otes", "Works [Cc]ited",
        "References", "Sources", "Citations", "Bibliography", "Further [Rr]eading", "External [Ll]inks",
    ]
    for head in order:
        text = rf"regexp_replace({text}, '(?s){head}[\s\p{{Z}}]\n.*', '')"
    return text


BODIES = f"bodies AS (SELECT record_id, {body('text')} AS text FROM articles)"
ORACLES["article_bodies"] = with_(ARTICLES, BODIES) + "SELECT record_id, text FROM bodies"

BOOKS = r"""books AS (
  SELECT doc_id AS record_id, regexp_replace(text, '([.,!?;:%])', ' \1 ', 'g')
    || ' `` he ca n''t say ( now ) '''' , it ''s 5 % of $ 7 -- wan na ? ' AS text FROM documents)"""


def detokenized(text: str) -> str:
    """The spacing rules, written out once more."""
    padded = [
        (r"(?i) (''t)\s(is|was)\b", r" \1\2"),
        (r"(?i)\b(can)\s(not)\b", r"\1\2"),
        (r"(?i)\b(d)\s(''ye)\b", r"\1\2"),
        (r"(?i)\b(gim)\s(me)\b", r"\1\2"),
        (r"(?i)\b(gon)\s(na)\b", r"\1\2"),
        (r"(?i)\b(got)\s(ta)\b", r"\1\2"),
        (r"(?i)\b(lem)\s(me)\b", r"\1\2"),
        (r"(?i)\b(more)\s(''n)\b", r"\1\2"),
        (r"(?i)\b(wan)\s(na)\b", r"\1\2"),
        (r"([^'' ])\s(''ll|''LL|''re|''RE|''ve|''VE|n''t|N''T) ", r"\1\2 "),
        (r"([^'' ])\s(''[sS]|''[mM]|''[dD]|'') ", r"\1\2 "),
        (r"(\S)\s('''')", r"\1\2"),
        (r"('''')\s([.,:)\]>};%])", r"\1\2"),
        (r"''''", '"'),
    ]
    trimmed = [
        (r" -- ", "--"),
        (r"([\[({<])\s", r"\1"),
        (r"\s([\])}>])", r"\1"),
        (r"([\])}>])\s([:;,.])", r"\1\2"),
        (r"([^''])\s''\s", r"\1'' "),
        (r"\s([?!])", r"\1"),
        (r"""([^.])\s(\.)([\])}>"'']*)\s*$""", r"\1\2\3"),
        (r"([#$])\s", r"\1"),
        (r"\s([;%])", r"\1"),
        (r"\s\.\.\.\s", "..."),
        (r"\s([:,])", r"\1"),
        (r"([ (\[{<])\s``", r"\1``"),
        (r"(``)\s", r"\1"),
        (r"``", '"'),
    ]
    out = rf"(' ' || trim(regexp_replace({text}, '[\s\p{{Z}}]+', ' ', 'g')) || ' ')"
    for pattern, replacement in padded:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    out = f"trim({out})"
    for pattern, replacement in trimmed:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"trim({out})"


ORACLES["detokenize"] = with_(BOOKS) + f"SELECT record_id, {detokenized('text')} AS text FROM books"
ORACLES["recipe_bookcorpus"] = (
    with_(BOOKS, f"plain AS (SELECT record_id, {detokenized('text')} AS text FROM books)")
    + f"SELECT record_id, {norm('text')} AS text FROM plain"
)
ORACLES["clean_data_job"] = (
    with_(f"plain AS (SELECT doc_id AS record_id, {detokenized('text')} AS text FROM documents)")
    + f"SELECT record_id, {norm('text')} AS text FROM plain"
)
ORACLES["recipe_commoncrawl"] = (
    with_(*RULES) + "SELECT record_id, sent_no, length(text)::INT AS n_chars FROM sentences"
)
PRE = rf"""articles0 AS (SELECT * FROM articles),
pre AS (SELECT record_id, regexp_replace(text, '[^\P{{C}}\n\t\r]', chr(10), 'g') AS text FROM articles0),
cut AS (SELECT record_id, {body('text')} AS text FROM pre)"""
ORACLES["recipe_wikipedia"] = (
    with_(ARTICLES, PRE, *rule_sentences("text", "cut")) + "SELECT record_id, sent_no, text FROM sentences"
)

# -- lookups ---------------------------------------------------------------------------

KNOWN = "known AS (SELECT * FROM vocab WHERE NOT is_infrequent)"
ORACLES["lookup_ids"] = with_(*VOCAB, *WORDS2, KNOWN) + """
SELECT w.word, coalesce(k.id, 0)::INT AS id FROM words2 w LEFT JOIN known k ON w.word = k.word"""
ORACLES["missing_words"] = with_(*VOCAB, *WORDS2, KNOWN) + """
SELECT word FROM words2 WHERE word NOT IN (SELECT word FROM known)"""
ORACLES["contained_words"] = with_(*VOCAB, *WORDS2, KNOWN) + """
SELECT word, word IN (SELECT word FROM known) AS in_vocab FROM words2"""
ORACLES["lookup_weights"] = with_(*COUNTS, WEIGHTS, *WORDS2) + """
SELECT w.word, round(coalesce(k.keep_prob, 1.0), 6) AS keep_prob FROM words2 w LEFT JOIN weights k ON w.word = k.word"""
ORACLES["delete_words"] = (
    with_(*COUNTS, "rest AS (SELECT * FROM counts WHERE word NOT IN ('.', 'the', 'de'))", vocab("rest")) + VOCAB_COLUMNS
)
ORACLES["look_up_vectors"] = with_(*ENC) + """
SELECT r.record_id, count(*) AS n_rows, count(e.vec_id) AS n_found, round(sum(e.embedding[1]::DOUBLE), 6) AS sum_first
FROM enc_rows r LEFT JOIN embeddings e ON r.id = e.vec_id GROUP BY r.record_id"""

# -- vocabulary ------------------------------------------------------------------------

ORACLES["word_count"] = with_(*COUNTS) + "SELECT word, cnt FROM counts"
ORACLES["word_count_rollup"] = with_(DOCS) + """
SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest(tok) AS word FROM docs) GROUP BY GROUPING SETS ((lang, word), (word))"""


def passes(size: int, source: str = "docs") -> list[str]:
    def members(name: str, counts: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT '<UNK>' AS word UNION ALL SELECT word FROM (
          SELECT word FROM {counts} WHERE word <> '<UNK>' ORDER BY cnt DESC, word LIMIT {size - 1}))"""

    def gram_counts(name: str, n: int, listed: str) -> str:
        return f"""{name} AS MATERIALIZED (
          SELECT word, count(*) AS cnt FROM ({grams(n, source, listed)}) GROUP BY word HAVING count(*) > 1)"""

    return [
        count(source, "all_words"),
        "p1 AS (SELECT * FROM all_words WHERE cnt > 1)",
        members("m1", "p1"),
        gram_counts("g2", 2, "m1"),
        "p2 AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM p1 UNION ALL SELECT * FROM g2) GROUP BY word)",
        members("m2", "p2"),
        gram_counts("g3", 3, "m2"),
        "p3 AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM p2 UNION ALL SELECT * FROM g3) GROUP BY word)",
    ]


ORACLES["ngram_passes"] = (
    with_(DOCS, *passes(SIZE)) + "SELECT word, cnt, len(string_split(word, ' '))::INT AS n FROM p3"
)
ORACLES["build_vocab_job"] = (
    with_(DOCS, *passes(60_000), vocab("p3", 60_000, 3, "'<UNK>'")) + VOCAB_COLUMNS
)
ORACLES["vocabulary_table"] = with_(*VOCAB) + VOCAB_COLUMNS
ORACLES["stream_vocabulary"] = ORACLES["vocabulary_table"]
ORACLES["stream_running"] = ORACLES["vocabulary_table"]
ORACLES["vocabulary_items"] = with_(*VOCAB) + f"""
SELECT item, coalesce((SELECT id::VARCHAR FROM vocab WHERE word = item AND NOT is_infrequent), '0') AS found
FROM (SELECT unnest(['<S>', 'the', 'de', 'no such word']) AS item)
UNION ALL SELECT i::VARCHAR, coalesce((SELECT word FROM vocab WHERE id = CASE WHEN i < 0 THEN i + (SELECT count(*) FROM vocab) ELSE i END), '<UNK>')
FROM (SELECT unnest([0, 1, 7, {SIZE} - 1, {SIZE} + 5, -1]) AS i)"""
ORACLES["update_vocabulary"] = (
    with_(
        DOCS, TURNS, count("docs", "c1"), count("turns", "c2"),
        """counts AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY word)""",
        vocab(),
    )
    + VOCAB_COLUMNS
)
ORACLES["id_to_word"] = with_(*VOCAB) + f"""
SELECT a.id, coalesce(v.word, '<UNK>') AS word FROM (SELECT (vec_id * 13 - 40)::INT AS id FROM embeddings) a
LEFT JOIN vocab v ON CASE WHEN a.id < 0 THEN a.id + (SELECT count(*) FROM vocab) ELSE a.id END = v.id"""
ORACLES["word_frequency"] = with_(*COUNTS, *WORDS2) + """
SELECT w.word, coalesce(c.cnt, 0)::BIGINT AS cnt FROM words2 w LEFT JOIN counts c ON w.word = c.word"""
ORACLES["encodable_words"] = with_(*VOCAB, KNOWN) + "SELECT word, id FROM known"
ORACLES["vocabulary_summary"] = with_(*VOCAB) + """
SELECT (SELECT count(*) FROM vocab) AS length, (SELECT sum(cnt)::BIGINT FROM counts) AS total,
       (SELECT count(*) FROM counts WHERE cnt < 3) AS n_infrequent,
       (SELECT string_agg(word, ' ' ORDER BY id) FROM vocab WHERE is_special) AS specials"""
ORACLES["count_frequencies"] = with_(*COUNTS) + "SELECT cnt, count(*) AS n_words FROM counts GROUP BY cnt"

# -- encoding --------------------------------------------------------------------------

ORACLES["encode_documents"] = with_(*ENC) + """
SELECT record_id, array_to_string(ids, ' ') AS ids, array_to_string(tokens, ' ') AS tokens, len(ids)::INT AS attended FROM enc"""
ORACLES["encode_documents_join"] = ORACLES["encode_documents"]
ORACLES["stream_encode"] = ORACLES["encode_documents"]
ORACLES["encode_pairs"] = with_(*VOCAB, TURNS, encoded("turns")) + """
SELECT a.record_id // 1000 AS conv_id, a.record_id % 1000 AS turn, array_to_string(a.ids || b.ids, ' ') AS ids,
       array_to_string(list_transform(a.ids, lambda x: 0) || list_transform(b.ids, lambda x: 1), ' ') AS type_ids
FROM enc a JOIN enc b ON b.record_id = a.record_id + 1"""
ORACLES["decode_ids"] = with_(*ENC) + "SELECT record_id, array_to_string(tokens, ' ') AS tokens FROM enc"

# -- splits, mixes, samples ------------------------------------------------------------

ORACLES["split_exact"] = f"""
SELECT record_id, CASE WHEN r <= floor(n * 0.75) THEN 'train' WHEN r <= n - floor(n * 0.10) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id AS record_id, row_number() OVER (ORDER BY {digest('1337', 'doc_id')}) AS r, count(*) OVER () AS n FROM documents)"""
ORACLES["split_by_share"] = f"""
SELECT record_id, CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id AS record_id, {state('1337', 'doc_id')} / 2147483647.0::DOUBLE AS u FROM documents)"""
ORACLES["proportional_weights"] = """
SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM documents GROUP BY source"""


def mixed(name: str, rows: str, weight: float) -> str:
    return f"""SELECT '{name}' AS source, record_id, unnest(range(0, (copies + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT))::INT AS copy_no
    FROM (SELECT record_id, row_number() OVER (ORDER BY {digest('1337:' + name, 'record_id')}) AS r,
                 floor(total * {weight} + 0.5)::BIGINT // n AS copies, floor(total * {weight} + 0.5)::BIGINT % n AS rest
          FROM (SELECT record_id, count(*) OVER () AS n, (SELECT t FROM total) AS total FROM {rows}))"""


MIXED = f"""d AS (SELECT doc_id AS record_id FROM documents), c AS (SELECT conv_id * 1000 + turn AS record_id FROM conversations),
b AS (SELECT item_id AS record_id FROM benchmark),
total AS (SELECT greatest((SELECT count(*) FROM d) / 0.5::DOUBLE, (SELECT count(*) FROM c) / 0.3::DOUBLE,
                          (SELECT count(*) FROM b) / 0.2::DOUBLE) AS t),
mixed AS ({mixed('documents', 'd', 0.5)} UNION ALL {mixed('turns', 'c', 0.3)} UNION ALL {mixed('benchmark', 'b', 0.2)})"""
ORACLES["interleave"] = with_(MIXED) + "SELECT source, record_id, copy_no FROM mixed"
ORACLES["interleave_order"] = with_(MIXED) + f"""
SELECT source, record_id, copy_no, row_number() OVER (ORDER BY {digest('1337', 'source', 'copy_no', 'record_id')}) - 1 AS position FROM mixed"""
ORACLES["train_job"] = with_(DOCS, TURNS) + f"""
SELECT phase, 2::BIGINT AS n_epochs, TRUE AS falls, count(*) AS n_records, sum(n_ids)::BIGINT AS n_ids FROM (
  SELECT n_ids, CASE WHEN r <= floor(n * 0.75) THEN 'train' WHEN r <= n - floor(n * 0.10) THEN 'val' ELSE 'test' END AS phase FROM (
    SELECT len(tok) + 2 AS n_ids, row_number() OVER (PARTITION BY source ORDER BY {digest('1337', 'record_id')}) AS r, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT 'd' AS source, record_id, tok FROM docs UNION ALL SELECT 't', record_id, tok FROM turns)))
WHERE phase <> 'test' GROUP BY phase"""
ORACLES["shuffle_order"] = f"""
SELECT doc_id AS record_id, row_number() OVER (ORDER BY {digest('1337:0', 'doc_id')}) - 1 AS position FROM documents"""
BATCHES = f"""batches AS (
  SELECT doc_id AS record_id, length(text) AS n_chars,
         ((row_number() OVER (ORDER BY {digest('1337', 'doc_id')}) - 1) // 64)::BIGINT AS batch_no FROM documents)"""
ORACLES["record_batches"] = with_(BATCHES) + "SELECT record_id, batch_no FROM batches"
ORACLES["collate_batches"] = with_(BATCHES) + """
SELECT batch_no, count(*)::INT AS n_records, string_agg(n_chars::VARCHAR, ' ' ORDER BY record_id) AS sizes
FROM batches GROUP BY batch_no"""
ORACLES["collate_function"] = with_(BATCHES) + """
SELECT batch_no, count(*) AS n_records, sum(n_chars)::BIGINT AS n_chars FROM batches GROUP BY batch_no"""
ORACLES["keep_weights"] = with_(*COUNTS, WEIGHTS) + "SELECT word, cnt, round(keep_prob, 6) AS keep_prob FROM weights"
ORACLES["subsample_words"] = with_(*ENC, WEIGHTS) + f"""
SELECT record_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY pos) FILTER (p > u), '') AS ids FROM (
  SELECT r.record_id, r.pos, r.id, coalesce(w.keep_prob, 1.0) AS p, {uniform(state('1337', 'r.record_id'), 'r.pos')} AS u
  FROM enc_rows r JOIN vocab v ON r.id = v.id LEFT JOIN weights w ON v.word = w.word)
GROUP BY record_id"""
ORACLES["subsample_tokens"] = with_(*COUNTS, WEIGHTS) + f"""
SELECT record_id, count(*) AS n_kept, sum(pos)::BIGINT AS sum_pos, sum(length(word))::BIGINT AS n_chars FROM (
  SELECT r.*, coalesce(w.keep_prob, 1.0) AS p, {uniform(state('1337', 'record_id'), 'pos')} AS u
  FROM (SELECT record_id, generate_subscripts(tok, 1) - 1 AS pos, unnest(tok) AS word FROM docs) r
  LEFT JOIN weights w ON r.word = w.word) WHERE p > u GROUP BY record_id"""
ORACLES["negative_distribution"] = with_(*VOCAB) + """
SELECT id, word, cnt, round(w / total, 9) AS prob, round((upto - w) / total, 9) AS low, round(upto / total, 9) AS high
FROM (SELECT id, word, cnt, w, sum(w) OVER () AS total, sum(w) OVER (ORDER BY id) AS upto
      FROM (SELECT id, word, cnt, cnt::DOUBLE ** 0.75 AS w FROM vocab WHERE NOT is_special))"""

# -- training examples -----------------------------------------------------------------


def starts(reach: str = "4") -> str:
    return f"unnest(range(0, len(ids) - 2 * {reach}))"


ORACLES["context_windows"] = with_(*ENC) + f"""
SELECT record_id, start::INT AS start, array_to_string(list_slice(ids, start + 1, start + 9), ' ') AS ids FROM (
  SELECT record_id, ids, {starts()} AS start FROM (
    SELECT record_id, ids FROM enc WHERE len(ids) >= 9))"""
ORACLES["cbow_examples"] = with_(*THIN) + f"""
SELECT record_id, start::INT AS start,
  array_to_string(list_slice(ids, start + 1, start + 4) || list_slice(ids, start + 6, start + 9), ' ') AS context,
  ids[start + 5] AS center
FROM (SELECT record_id, ids, {starts()} AS start FROM thin WHERE len(ids) >= 9)"""
ORACLES["skipgram_pairs"] = with_(*THIN) + f"""
SELECT record_id, center, (sum(2 * reach))::BIGINT AS n_pairs, sum(targets)::BIGINT AS sum_targets,
       sum(2 * reach)::BIGINT AS n_positive FROM (
  SELECT record_id, reach, ids[start + reach + 1] AS center,
         list_sum(list_slice(ids, start + 1, start + 2 * reach + 1)) - ids[start + reach + 1] AS targets
  FROM (SELECT record_id, ids, reach, {starts('reach')} AS start FROM (
    SELECT *, {state('1337:reach', 'record_id')} % 4 + 1 AS reach FROM thin) WHERE len(ids) >= 2 * reach + 1))
GROUP BY record_id, center"""

# draws: a uniform number over the mass of the words still allowed, moved past the intervals of the others in order
DRAWN_FROM = """neg AS MATERIALIZED (
  SELECT id, high, coalesce(lag(high) OVER (ORDER BY id), 0.0) AS low FROM (
    SELECT id, sum(w) OVER (ORDER BY id) / sum(w) OVER () AS high FROM (SELECT id, cnt::DOUBLE ** 0.75 AS w FROM vocab WHERE NOT is_special)))"""


def draws(k: int) -> list[str]:
    """Tables draw1 to draw``k``: (record_id, start, drawn, taken), each with one more id drawn."""
    tables = [f"""windowed AS MATERIALIZED (
  SELECT record_id, start, reach, ids[start + reach + 1] AS center,
    list_slice(ids, start + 1, start + reach) || list_slice(ids, start + reach + 2, start + 2 * reach + 1) AS context,
    {state('1337', 'record_id', 'start')} AS state
  FROM (SELECT record_id, ids, reach, {starts('reach')} AS start FROM (
    SELECT *, {state('1337:reach', 'record_id')} % 4 + 1 AS reach FROM thin) WHERE len(ids) >= 2 * reach + 1)),
draw0 AS MATERIALIZED (
  SELECT a.record_id, a.start, any_value(a.state) AS state, []::INT[] AS drawn,
    coalesce(list({{'low': n.low, 'w': n.high - n.low}} ORDER BY n.low) FILTER (n.id IS NOT NULL), []) AS taken
  FROM (SELECT record_id, start, state, unnest(list_distinct(list_append(context, center))) AS id FROM windowed) a LEFT JOIN neg n ON n.id = a.id
  GROUP BY a.record_id, a.start)"""]
    for i in range(k):
        tables.append(f"""point{i + 1} AS (
  SELECT *, list_reduce(list_prepend({{'low': u * ((SELECT max(high) FROM neg) - coalesce(list_sum(list_transform(taken, lambda x: x.w)), 0.0)), 'w': 0.0}}, taken),
    lambda p, x: CASE WHEN x.low <= p.low THEN {{'low': p.low + x.w, 'w': 0.0}} ELSE p END).low AS point
  FROM (SELECT *, {uniform('state', str(i))} AS u FROM draw{i})),
draw{i + 1} AS MATERIALIZED (
  SELECT p.record_id, p.start, p.state, list_append(p.drawn, n.id) AS drawn, list_sort(list_append(p.taken, {{'low': n.low, 'w': n.high - n.low}})) AS taken
  FROM point{i + 1} p ASOF JOIN neg n ON p.point < n.high)""")
    return tables


ORACLES["draw_negatives"] = with_(*THIN, DRAWN_FROM, *draws(5)) + """
SELECT w.record_id, w.start::INT AS start, w.center, array_to_string(d.drawn, ' ') AS negatives FROM windowed w JOIN draw5 d USING (record_id, start)"""
ORACLES["skipgram_examples"] = with_(*THIN, DRAWN_FROM, *draws(5)) + """
SELECT record_id, center, sum(len(context) + len(drawn))::BIGINT AS n_pairs, sum(list_sum(context) + list_sum(drawn))::BIGINT AS sum_targets,
  sum(len(context))::BIGINT AS n_positive FROM windowed JOIN draw5 USING (record_id, start) GROUP BY record_id, center"""

# -- ranks, windows, logs --------------------------------------------------------------

RANKED = "ranked AS (SELECT word, cnt, (row_number() OVER (ORDER BY cnt DESC, word) - 1)::INT AS rank FROM counts)"
ORACLES["words_at_ranks"] = (
    with_(*COUNTS, RANKED) + "SELECT word, cnt, rank FROM ranked WHERE rank IN (0, 10, 100, 1000, 4000, 8000)"
)
ORACLES["step_numbers"] = with_(LOSSES) + """
SELECT run, epoch, step AS id, row_number() OVER (PARTITION BY run, epoch ORDER BY step) - 1 AS step FROM losses"""
ORACLES["running_loss"] = with_(LOSSES) + """
SELECT run, epoch, step, round(m + 1e-11, 9) AS mean_loss FROM (
  SELECT *, avg(loss) OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING) AS m FROM losses)
WHERE step % 25 = 24"""
ORACLES["epoch_losses"] = with_(LOSSES) + """
SELECT run, epoch, round(avg(loss) FILTER (phase = 'train') + 1e-11, 9) AS train, round(avg(loss) FILTER (phase = 'val') + 1e-11, 9) AS val
FROM losses GROUP BY run, epoch"""
ORACLES["learning_rates"] = with_(LOSSES) + """
SELECT epoch, count(*) AS n_steps, round(0.025 * ((SELECT max(epoch) + 1 FROM losses) - epoch) / (SELECT max(epoch) + 1 FROM losses), 6) AS rate
FROM losses GROUP BY epoch"""

# -- statistics ------------------------------------------------------------------------

ORACLES["describe_counts"] = with_(*COUNTS) + describe("counts WHERE cnt > 1", "cnt")
ORACLES["describe_frequencies"] = with_(*COUNTS) + describe(
    "(SELECT cnt, count(*) AS n_words FROM counts WHERE cnt > 1 GROUP BY cnt)", "n_words"
)
ORACLES["common_frequencies"] = with_(*COUNTS) + """
SELECT cnt, n_words, round(n_words / total, 6) AS share FROM (
  SELECT cnt, count(*) AS n_words, sum(count(*)) OVER () AS total FROM counts WHERE cnt > 1 GROUP BY cnt)
ORDER BY n_words DESC, cnt LIMIT 10"""
ORACLES["vocabulary_cutoffs"] = with_(*COUNTS, RANKED) + """
SELECT rank + 1 AS size, word, cnt, round(covered / total, 6) AS coverage FROM (
  SELECT *, sum(cnt) OVER (ORDER BY rank) AS covered, sum(cnt) OVER () AS total FROM ranked)
WHERE rank + 1 IN (100, 1000, 5000, 10000)"""
LENGTHS = "lengths AS (SELECT record_id, (len(tok) + 2)::INT AS length FROM docs)"
ORACLES["describe_lengths"] = with_(DOCS, LENGTHS) + describe("lengths", "length")
ORACLES["length_histogram"] = with_(DOCS, LENGTHS) + "SELECT length, count(*) AS n_records FROM lengths GROUP BY length"
ORACLES["describe_length_histogram"] = with_(DOCS, LENGTHS) + describe(
    "(SELECT count(*) AS n FROM lengths GROUP BY length)", "n"
)
ORACLES["length_shares"] = with_(DOCS, LENGTHS) + """
SELECT length, count(*) AS n_records, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lengths GROUP BY length"""
ORACLES["context_retention"] = with_(DOCS, LENGTHS) + """
SELECT n::INT AS n_context, round(avg(CASE WHEN length >= 2 * n + 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share
FROM lengths, (SELECT unnest([1, 2, 3, 4, 5, 10, 20, 50]) AS n) GROUP BY n"""
ORACLES["keep_curves"] = with_(*COUNTS) + """
SELECT round(t, 6) AS t, i, round(x, 6) AS x, round((sqrt(x / total / t) + 1) * t / (x / total), 6) AS keep_prob FROM (
  SELECT t, i, 1.0 + (i * (1.0::DOUBLE / 9999)) * ((SELECT max(cnt) FROM counts)::DOUBLE - 1.0) AS x,
         (SELECT sum(cnt) FROM counts)::DOUBLE AS total
  FROM range(0, 10000) g(i), (SELECT unnest([1e-2, 1e-3, 1e-4]::DOUBLE[]) AS t))"""

# -- numbers ---------------------------------------------------------------------------

ORACLES["activations"] = with_(COMPONENTS) + """
SELECT id, pos, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(1 / (1 + exp(-2.0 * x)), 6) AS sigmoid2, round(tanh(x), 6) AS tanh,
  round(greatest(x, 0.0), 6) AS relu, round(greatest(x, 0.01 * x), 6) AS leakyrelu, round(x / (1 + exp(-x)), 6) AS swish FROM x"""
ERF = "list_sum(list_transform(range(0, 25), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
ORACLES["gelu_activation"] = with_(COMPONENTS) + f"""
SELECT id, pos, round(0.5 * x * (1 + 2 / sqrt(pi()) * {ERF}), 6) AS gelu FROM (SELECT *, x / sqrt(2) AS z FROM x)"""


def slope(series: str, x: str, y: str, source: str) -> str:
    return f"""SELECT {series}, {x}, CASE
      WHEN x0 IS NOT NULL AND x2 IS NOT NULL THEN
        ((x1 - x0) ** 2 * y2 + ((x2 - x1) ** 2 - (x1 - x0) ** 2) * y1 - (x2 - x1) ** 2 * y0) / ((x1 - x0) * (x2 - x1) * (x2 - x0))
      WHEN x2 IS NOT NULL THEN (y2 - y1) / (x2 - x1) WHEN x0 IS NOT NULL THEN (y1 - y0) / (x1 - x0) END AS slope
    FROM (SELECT {series}, {x}, {x}::DOUBLE AS x1, {y}::DOUBLE AS y1,
      lag({x}) OVER w::DOUBLE AS x0, lead({x}) OVER w::DOUBLE AS x2, lag({y}) OVER w::DOUBLE AS y0, lead({y}) OVER w::DOUBLE AS y2
      FROM {source} WINDOW w AS (PARTITION BY {series} ORDER BY {x}))"""


ORACLES["series_gradient"] = (
    with_(LOSSES) + f"SELECT run, step, round(slope + 1e-9, 6) AS slope FROM ({slope('run', 'step', 'loss', 'losses')})"
)
ORACLES["activation_gradient"] = (
    with_(COMPONENTS, "curve AS (SELECT DISTINCT label, x, x / (1 + exp(-x)) AS y FROM x)")
    + f"SELECT label, count(slope) AS n, round(avg(slope), 5) AS mean_slope FROM ({slope('label', 'x', 'y', 'curve')}) GROUP BY label"
)
ORACLES["layer_moments"] = with_(COMPONENTS) + """
SELECT label, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY label"""
ORACLES["layer_histogram"] = with_(COMPONENTS) + """
SELECT label, least(floor((x + 1.0) * 15.0)::INT, 29) AS bin, count(*) AS n FROM x WHERE x BETWEEN -1 AND 1 GROUP BY 1, 2"""

# -- vectors ---------------------------------------------------------------------------

ORACLES["clip_norms"] = """
WITH wide AS (SELECT vec_id::INT AS id, list_transform(embedding, lambda v: v::DOUBLE * (vec_id % 3)) AS v FROM embeddings),
normed AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM wide)
SELECT id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v) * CASE WHEN n > 1 THEN 1 / n ELSE 1.0 END, 6) AS x FROM normed"""
ORACLES["context_means"] = with_(*VOCAB, TURNS, encoded("turns")) + f"""
SELECT record_id, start::INT AS start, round(avg(e.embedding[1]::DOUBLE), 6) AS first, round(avg(e.embedding[64]::DOUBLE), 6) AS last
FROM (SELECT record_id, start, unnest(list_slice(ids, start + 1, start + 4) || list_slice(ids, start + 6, start + 9)) AS id
      FROM (SELECT record_id, ids, {starts()} AS start FROM (
        SELECT record_id, ids FROM enc WHERE len(ids) >= 9))) c
JOIN embeddings e ON e.vec_id = c.id % (SELECT count(*) FROM embeddings) GROUP BY record_id, start"""
# a logit is the mean over the context of inner products, plus a bias; gram holds the inner products of each vector with all
GRAM = """vecs AS MATERIALIZED (
  SELECT vec_id::INT AS id, embedding::DOUBLE[] AS v, vec_id % 3 / 10.0::DOUBLE AS bias, (vec_id % 7 + 1) / (sum(vec_id % 7 + 1) OVER ())::DOUBLE AS prob
  FROM embeddings),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS dot FROM vecs a, vecs b),
gram AS MATERIALIZED (SELECT a, list(dot ORDER BY b) AS dots FROM pairs GROUP BY a),
biases AS MATERIALIZED (SELECT list(bias ORDER BY id) AS biases FROM vecs)"""


def cbow(source: str) -> str:
    return f"""examples AS MATERIALIZED (
  SELECT record_id, start, list_transform(list_slice(ids, start + 1, start + 4) || list_slice(ids, start + 6, start + 9),
    lambda i: (i % size)::INT) AS context, (ids[start + 5] % size)::INT AS center
  FROM (SELECT record_id, ids, size, {starts()} AS start FROM {source}, (SELECT count(*) AS size FROM embeddings) WHERE len(ids) >= 9))"""


def softmax(bias: str) -> str:
    """Losses over all vectors: (record_id, start, loss)."""
    dots = " JOIN ".join(["examples e", *[f"gram g{i} ON g{i}.a = e.context[{i}]" for i in range(1, 9)]])
    total = " + ".join(f"g{i}.dots[j]" for i in range(1, 9))
    return f"""losses AS (
  SELECT record_id, start, ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[center + 1] AS loss FROM (
    SELECT e.record_id, e.start, e.center, list_transform(range(1, len(g1.dots) + 1), lambda j: ({total}) / 8 + {bias}) AS logits
    FROM {dots}, biases))"""


PER_RECORD = "SELECT record_id, count(*) AS n_examples, round(avg(loss), 6) AS loss FROM losses GROUP BY record_id"
CANDIDATES = """candidates AS (
  SELECT record_id, start, context, j, CASE WHEN j = 0 THEN center ELSE ((center * 7 + start * 3 + j * 13) % (SELECT count(*) FROM embeddings))::INT END AS id
  FROM examples, range(0, 6) r(j)),
logits AS (
  SELECT c.record_id, c.start, c.j, any_value(v.prob) AS prob, avg(p.dot) + any_value(v.bias) AS x
  FROM (SELECT *, unnest(context) AS a FROM candidates) c JOIN pairs p ON p.a = c.a AND p.b = c.id JOIN vecs v ON v.id = c.id
  GROUP BY c.record_id, c.start, c.j)"""
TURN_EXAMPLES = [*VOCAB, TURNS, encoded("turns"), GRAM, cbow("enc")]
ORACLES["score_softmax"] = with_(*TURN_EXAMPLES, softmax("biases[j]")) + PER_RECORD
ORACLES["score_negative_sampling"] = with_(*TURN_EXAMPLES, CANDIDATES, """losses AS (
  SELECT record_id, start, sum(ln(1 + exp(CASE WHEN j = 0 THEN -x ELSE x END))) AS loss FROM logits GROUP BY record_id, start)""") + PER_RECORD
ORACLES["score_sampled_softmax"] = with_(*TURN_EXAMPLES, CANDIDATES, """losses AS (
  SELECT record_id, start, ln(sum(exp(x - ln(5 * prob)))) - sum(x - ln(5 * prob)) FILTER (j = 0) AS loss
  FROM logits GROUP BY record_id, start)""") + PER_RECORD
ORACLES["score_examples"] = with_(*ENC, GRAM, cbow("enc"), softmax("0.0")) + """
SELECT round(avg(loss), 6) AS loss FROM (SELECT avg(loss) AS loss FROM losses GROUP BY record_id // 64)"""
ORACLES["analogy"] = """
WITH v AS (SELECT vec_id::INT AS id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT list_transform(list_zip((SELECT v FROM v WHERE id = 1), (SELECT v FROM v WHERE id = 2), (SELECT v FROM v WHERE id = 3)),
        lambda z: z[1] - z[2] + z[3]) AS q)
SELECT id, round(list_cosine_similarity(v, q), 6) AS similarity FROM v, q WHERE id NOT IN (1, 2, 3)
ORDER BY list_cosine_similarity(v, q) DESC, id LIMIT 10"""
ORACLES["discriminant_axes"] = "WITH " + COMPONENTS + """, labelled AS (SELECT * FROM x WHERE label IS NOT NULL),
per AS (SELECT label, pos, count(*) AS n, avg(x) AS m, sum(x * x) - sum(x) * sum(x) / count(*) AS w FROM labelled GROUP BY label, pos),
mean AS (SELECT pos, avg(x) AS m FROM labelled GROUP BY pos)
SELECT axis::INT AS axis, TRUE AS holds, (SELECT count(DISTINCT id) FROM labelled) AS n,
  (SELECT round(sum(p.n * (p.m - a.m) ** 2), 6) FROM per p JOIN mean a USING (pos)) AS between, (SELECT round(sum(w), 6) FROM per) AS within
FROM range(1, (SELECT least(count(DISTINCT label) - 1, count(DISTINCT pos)) FROM labelled) + 1) r(axis)"""
# the first axis by squaring the covariance: its powers come ever nearer to a multiple of axis times axis
SQUARES = ["cov AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (id) GROUP BY a.pos, b.pos)",
           "m0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i))"]
SQUARES += [f"""m{k + 1} AS MATERIALIZED (
  SELECT list_transform(q, lambda r: list_transform(r, lambda c: c / t)) AS m FROM (
    SELECT q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t FROM (
      SELECT list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c))) AS q FROM m{k})))""" for k in range(24)]
ORACLES["principal_axes"] = with_(COMPONENTS, *SQUARES) + """
SELECT vec_id::INT AS id, round(abs(list_inner_product(embedding::DOUBLE[], axis)), 4) AS axis1 FROM embeddings, (
  SELECT list_transform(r, lambda c: c / sqrt(list_inner_product(r, r))) AS axis FROM (SELECT unnest(m) AS r FROM m24)
  ORDER BY list_inner_product(r, r) DESC LIMIT 1)"""
KNOWN_IDS = "known_ids AS (SELECT id, word FROM vocab WHERE NOT is_infrequent)"
ORACLES["train_vectors"] = with_(*VOCAB, KNOWN_IDS) + "SELECT id, word, 16::INT AS dimension FROM known_ids"
ORACLES["model_checkpoints"] = with_(*VOCAB, KNOWN_IDS) + """
SELECT saved, (SELECT count(*) FROM known_ids) AS n_vectors FROM (SELECT unnest(['checkpoint_1', 'checkpoint_2', 'model']) AS saved)"""
ORACLES["principal_equations"] = "SELECT axis::INT AS axis, TRUE AS holds FROM range(1, 3) r(axis)"


def merged_pieces(merges: int) -> list[str]:
    """Words as texts of symbols, each its number between two control characters, after so many merges one by one."""
    tables = ["""letters AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY c) - 1 AS id, c AS piece FROM (
    SELECT DISTINCT unnest(string_split('\u2581' || word, '')) AS c FROM counts)),
symbols0 AS MATERIALIZED (SELECT id, piece FROM letters),
words0 AS MATERIALIZED (
  SELECT word, cnt, string_agg(chr(1) || id || chr(2), '' ORDER BY pos) AS t FROM (
    SELECT word, cnt, unnest(string_split('\u2581' || word, '')) AS c, generate_subscripts(string_split('\u2581' || word, ''), 1) AS pos FROM counts) w
  JOIN letters ON w.c = letters.piece GROUP BY word, cnt)"""]
    for i in range(merges):
        tables.append(f"""top{i + 1} AS MATERIALIZED (
  SELECT l, r FROM (
    SELECT s[k]::BIGINT AS l, s[k + 1]::BIGINT AS r, cnt FROM (
      SELECT cnt, s, unnest(range(1, len(s))) AS k FROM (SELECT cnt, string_split(replace(t[2:-2], chr(2) || chr(1), ' '), ' ') AS s FROM words{i})))
  GROUP BY l, r HAVING sum(cnt) >= 2 ORDER BY sum(cnt) DESC, greatest(l, r), l, r LIMIT 1),
symbols{i + 1} AS MATERIALIZED (
  SELECT * FROM symbols{i} UNION ALL
  SELECT (SELECT count(*) FROM symbols{i}), a.piece || b.piece FROM top{i + 1} JOIN symbols{i} a ON a.id = l JOIN symbols{i} b ON b.id = r),
words{i + 1} AS MATERIALIZED (
  SELECT word, cnt, coalesce(replace(t, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || (SELECT count(*) FROM symbols{i}) || chr(2)), t) AS t
  FROM words{i} LEFT JOIN top{i + 1} ON TRUE)""")
    return tables


ORACLES["subword_counts"] = with_(*COUNTS, *merged_pieces(48)) + """
SELECT piece AS word, sum(cnt)::BIGINT AS cnt FROM (
  SELECT unnest(string_split(replace(t[2:-2], chr(2) || chr(1), ' '), ' '))::BIGINT AS id, cnt FROM words48) JOIN symbols48 USING (id) GROUP BY piece"""

# -- streams ---------------------------------------------------------------------------

ORACLES["stream_clean"] = PLAIN_SENTENCES
