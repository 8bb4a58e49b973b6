"""The same queries in SQL for DuckDB, written over a token table built in SQL.

RE2 has no look-around, so clitics end at a word boundary here; the driver's texts do not tell the
two apart. White space is spelled out as in the package.
"""

from __future__ import annotations

import csv

from stylograph.functions.lexicons import (
    ALL_SERIES,
    ARCHAIC_WORDS,
    FUNCTION_WORDS,
    PUNCTUATION_GROUPS,
    SENTENCE_KINDS,
    STOP_WORDS,
)
from stylograph.operators.measures import SURFACE
from stylograph.operators.tokens import LEMMA_ENDINGS, POS_ENDINGS
from stylograph.plans.warehouse import MART_CHECKS
from stylograph.sources.seeds import METRICS_FILE
from suite.inputs import CONTRACTIONS, MARKUP_SAMPLES, OPEN_SAMPLES, PAGE_MARKS, SUBORDINATE_LENGTHS
from suite.queries import BANDS, CHOSEN_METRICS, CHUNK_CHARS, SUSPECT

BLANK = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
FILLED = r"[^\s\x0B\x1C-\x1F\x{85}\pZ]"
CLITIC = r"(?i)n[''’]t\b|[''’](?:s|re|ve|ll|m|d)\b"
TOKEN = CLITIC + r"|\pL+|\pN+|--|\.\.\.|[^\s\x0B\x1C-\x1F\x{85}\pZ\pL\pN]"
LOADED_AT = "TIMESTAMP '2024-01-02 03:04:05'"

DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS work_id, text FROM documents"
SPACED = "SELECT CAST(doc_id AS VARCHAR) AS work_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


def replaced(column: str, pairs) -> str:
    for old, new in pairs:
        column = "replace({}, '{}', '{}')".format(column, old.replace("'", "''"), new.replace("'", "''"))
    return column


CONTRACTED = f"SELECT CAST(doc_id AS VARCHAR) AS work_id, {replaced('text', CONTRACTIONS)} AS text FROM documents"


def _quoted(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\r\n\t'" else f"'{c}'" for c in text) or "''"


def between(samples) -> str:
    """The text between the before and after of the sample its number picks."""
    cases = " ".join(f"WHEN {n} THEN {_quoted(before)} || text || {_quoted(after)}" for n, (before, after) in enumerate(samples))
    return f"CASE doc_id % {len(samples)} {cases} END"


MARKED = f"SELECT CAST(doc_id AS VARCHAR) AS work_id, {between(MARKUP_SAMPLES)} AS text FROM documents"
SOURCES = f"SELECT source AS work_id, string_agg({between(OPEN_SAMPLES)}, '' ORDER BY doc_id) AS text FROM documents GROUP BY source"
SPACED_SOURCES = "SELECT source AS work_id, string_agg(replace(text, chr(10), chr(10) || chr(10)), '' ORDER BY doc_id) AS text FROM documents GROUP BY source"
TALKS = "SELECT CAST(conv_id AS VARCHAR) AS work_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
PAGES = f"SELECT CAST(page_id AS VARCHAR) AS work_id, {replaced('html', PAGE_MARKS)} AS text FROM pages"
BENCHMARK = "SELECT CAST(item_id AS VARCHAR) AS work_id, text FROM benchmark"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def number(condition: str) -> str:
    return f"CAST(count_if({condition}) AS BIGINT)"


def cleaned(text: str) -> str:
    # What counts as markup.
    for pattern, replacement in (
        (r"\r\n|\r", r"\n"),
        (r"\A---\n(?s:.*?)\n---\n", ""),
        (r"(?m)^[ \t]*#{1,6}[ \t].*$", ""),
        (r"(?m)^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*-{3,}[ \t]*$|^[ \t]*_{3,}[ \t]*$", ""),
        (r"(?m)^[ \t]*>[ \t]?", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
        (r"\*\*([^*]+)\*\*", r"\1"),
        (r"__([^_]+)__", r"\1"),
        (r"\*([^*\n]+)\*", r"\1"),
        (r"_([^_\n]+)_", r"\1"),
        (r"`([^`]+)`", r"\1"),
        (r"\n{3,}", r"\n\n"),
    ):
        if replacement.startswith(r"\n"):
            target = " || ".join(["chr(10)"] * replacement.count("n"))
        else:
            target = f"'{replacement}'"
        text = f"regexp_replace({text}, '{pattern}', {target}, 'g')"
    return rf"regexp_replace({text}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def tokens(source: str = DOCUMENTS, clean: bool = True) -> str:
    """CTEs ending in sent(work_id, sent_no, text) and tok, the token table."""
    text = cleaned("text") if clean else "text"
    return rf"""
source AS ({source}),
prose AS (SELECT work_id, {text} AS text FROM source),
marked AS (
  SELECT work_id, list_filter(string_split(regexp_replace(replace(text, chr(31), ' '),
    '([.!?…]+["”’)]*){BLANK}+|\n{BLANK}*\n', '\1' || chr(31), 'g'), chr(31)),
    lambda s: regexp_matches(s, '{FILLED}')) AS parts
  FROM prose),
sent AS (SELECT work_id, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS sent_no FROM marked),
listed AS (SELECT work_id, sent_no, regexp_extract_all(regexp_replace(text, '{CLITIC}', ' \0 ', 'g'), '{TOKEN}') AS parts FROM sent),
placed AS (
  SELECT work_id, sent_no, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS sent_tok_no FROM listed),
tok AS (
  SELECT work_id, sent_no, sent_tok_no, text, lower(text) AS lower,
    row_number() OVER (PARTITION BY work_id ORDER BY sent_no, sent_tok_no) AS tok_no,
    regexp_full_match(text, '\pL+') AS is_alpha, regexp_full_match(text, '\pP+') AS is_punct
  FROM placed)"""


def pos(lower: str = "lower") -> str:
    rules = " ".join(
        f"WHEN {lower} LIKE '%{ending}' AND length({lower}) >= {least} THEN '{label}'" for ending, least, label in POS_ENDINGS
    )
    return (
        rf"CASE WHEN is_punct THEN 'PUNCT' WHEN NOT is_alpha AND regexp_full_match({lower}, '\pN+') THEN 'NUM' "
        f"WHEN NOT is_alpha THEN 'X' {rules} ELSE 'NOUN' END"
    )


def lemma(lower: str = "lower") -> str:
    rules = " ".join(
        f"WHEN {lower} LIKE '%{ending}' AND length({lower}) >= {least} THEN left({lower}, length({lower}) - {cut}) || '{add}'"
        for ending, least, cut, add in LEMMA_ENDINGS
    )
    return f"CASE WHEN NOT is_alpha THEN {lower} {rules} ELSE {lower} END"


LABELS = f"""
tagged AS (SELECT *, {pos()} AS pos, {lemma()} AS lemma, lower IN ({sql_list(STOP_WORDS)}) AS is_stop FROM tok),
labelled AS (
  SELECT *,
    CASE WHEN sent_tok_no = 1 THEN 'ROOT' {" ".join(f"WHEN length(text) = {n} THEN '{d}'" for n, d in SUBORDINATE_LENGTHS.items())} WHEN pos = 'VERB' THEN 'conj' ELSE 'dep' END AS dep,
    CASE WHEN sent_tok_no = 1 THEN 1 WHEN sent_tok_no % 5 = 0 THEN sent_tok_no - 1 ELSE (sent_tok_no + 1) // 2 END AS head_no
  FROM tagged)"""

# Depths by walking down from the roots; kinds by joining a token to its head.
TREES = """
walk AS (
  SELECT work_id, sent_no, sent_tok_no, 0 AS depth FROM labelled WHERE head_no = sent_tok_no
  UNION ALL
  SELECT c.work_id, c.sent_no, c.sent_tok_no, w.depth + 1
  FROM labelled c JOIN walk w ON c.work_id = w.work_id AND c.sent_no = w.sent_no AND c.head_no = w.sent_tok_no
  WHERE c.head_no <> c.sent_tok_no),
depths AS (SELECT work_id, sent_no, max(depth) AS depth FROM walk GROUP BY ALL),
kinds AS (
  SELECT t.work_id, t.sent_no,
    CASE WHEN bool_or(t.dep IN ('advcl', 'ccomp', 'xcomp', 'acl', 'relcl', 'csubj')) THEN 'complex'
         WHEN bool_or(t.dep = 'conj' AND t.pos IN ('VERB', 'AUX') AND h.dep = 'ROOT') THEN 'compound'
         ELSE 'simple' END AS kind
  FROM labelled t JOIN labelled h ON t.work_id = h.work_id AND t.sent_no = h.sent_no AND t.head_no = h.sent_tok_no
  GROUP BY ALL),
trees AS (
  SELECT work_id, count(*) AS n_parsed_sentences, CAST(sum(depth) AS DOUBLE) / count(*) AS mean_parse_tree_depth,
""" + ",\n".join(
    f"    count_if(kind = '{kind}') / count(*) AS senttype_{kind}" for kind in SENTENCE_KINDS
) + """
  FROM depths JOIN kinds USING (work_id, sent_no) GROUP BY work_id)"""

WORDS = f"words AS (SELECT work_id, {number('is_alpha')} AS n_words FROM tok GROUP BY work_id)"
TYPES = """
types AS (SELECT work_id, lower AS term, count(*) AS n FROM tok WHERE is_alpha GROUP BY ALL),
rich AS (
  SELECT work_id, CAST(sum(n) AS BIGINT) AS big_n, CAST(sum(n * n) AS BIGINT) AS s2, count(*) AS v, count_if(n = 1) AS v1
  FROM types GROUP BY work_id)"""

LEXICAL = f"""
lexical AS (
  SELECT work_id,
    coalesce(sum(length(text)) FILTER (is_alpha) / nullif(count_if(is_alpha), 0), 0.0) AS mean_word_length,
    coalesce(count_if(is_alpha AND lower IN ({sql_list(ARCHAIC_WORDS)})) / nullif(count_if(is_alpha), 0), 0.0) AS archaic_word_rate,
""" + ",\n".join(
    f"    coalesce(count_if(is_alpha AND lower = '{w}') / nullif(count_if(is_alpha), 0), 0.0) AS \"funcword_{w}\"" for w in FUNCTION_WORDS
) + """
  FROM tok GROUP BY work_id),
richness AS (
  SELECT source.work_id,
    coalesce(10000.0::DOUBLE * (s2 - big_n) / (big_n::DOUBLE * big_n), 0.0) AS yules_k,
    CASE WHEN v1 < v THEN 100.0::DOUBLE * ln(big_n) / (1 - v1 / v) ELSE 0.0 END AS honore_r
  FROM source LEFT JOIN rich USING (work_id))"""

RHYTHM = """
lengths AS (SELECT work_id, sent_no, count_if(is_alpha) AS n FROM tok GROUP BY ALL),
rhythm AS (
  SELECT work_id, avg(n) AS mean_sentence_length,
    CASE WHEN count(*) > 1 THEN stddev_pop(n) ELSE 0.0 END AS sentence_length_stdev
  FROM lengths GROUP BY work_id)"""

PUNCTUATION = """
punctuation AS (
  SELECT work_id,
""" + ",\n".join(
    f"    coalesce(count_if(is_punct AND text IN ({sql_list(marks)})) / nullif(count_if(is_alpha), 0), 0.0) AS punct_{group}"
    for group, marks in PUNCTUATION_GROUPS.items()
) + """
  FROM tok GROUP BY work_id)"""

CONTRACTIONS = """
contractions AS (
  SELECT work_id, CAST(count_if(is_alpha) AS BIGINT) AS n_words,
    CAST(count_if(lower(replace(text, '’', '''')) IN ('n''t', '''re', '''ve', '''ll', '''m', '''d', '''s')) AS BIGINT) AS n_clitics
  FROM tok GROUP BY work_id)"""

QUOTES = """
flipped AS (
  SELECT work_id, tok_no, text, is_alpha,
    count_if(text = '"') OVER so_far AS k
  FROM tok WINDOW so_far AS (PARTITION BY work_id ORDER BY tok_no ROWS UNBOUNDED PRECEDING)),
switched AS (
  SELECT *,
    last_value(CASE text WHEN '“' THEN 1 WHEN '”' THEN 0 END IGNORE NULLS) OVER so_far AS state,
    last_value(CASE WHEN text IN ('“', '”') THEN k END IGNORE NULLS) OVER so_far AS at_k
  FROM flipped WINDOW so_far AS (PARTITION BY work_id ORDER BY tok_no ROWS UNBOUNDED PRECEDING)),
quoted AS (
  SELECT work_id, CAST(count_if(is_alpha) AS BIGINT) AS n_words,
    CAST(count_if(is_alpha AND (coalesce(state, 0) + k - coalesce(at_k, 0)) % 2 = 1) AS BIGINT) AS n_quoted
  FROM switched GROUP BY work_id)"""

SPEECH = """
speech AS (
  SELECT work_id, coalesce(count_if(pos = 'ADJ') / nullif(count_if(is_alpha), 0), 0.0) AS adjective_density,
    coalesce(count_if(pos = 'ADV') / nullif(count_if(is_alpha), 0), 0.0) AS adverb_density
  FROM tagged GROUP BY work_id)"""

VOCABULARY = """
vocab AS (
  SELECT work_id, lower(lemma) AS term, count(*) AS term_count FROM tagged
  WHERE is_alpha AND NOT is_stop AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') GROUP BY ALL)"""

CATALOGUE = """
catalogue AS (
  SELECT CAST(doc_id AS VARCHAR) AS work_id, 'Document, no. ' || doc_id AS title, source AS author, 'test' AS tradition,
    'now' AS era, source = 'src0' AS is_self, 'corpus/' || doc_id || '.md' AS path FROM documents)"""


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


ALL_PARTS = (tokens(), LABELS, TREES, TYPES, LEXICAL, RHYTHM, PUNCTUATION, CONTRACTIONS, QUOTES, SPEECH)
SERIES_COLUMNS = ", ".join(
    f'coalesce("{s}", 0.0)::DOUBLE AS "{s}"' for s in ALL_SERIES if s not in ("contraction_rate", "dialogue_narration_ratio")
)
TIDY = f"""
wide AS (
  SELECT source.work_id, {SERIES_COLUMNS},
    coalesce(n_clitics / nullif(contractions.n_words, 0), 0.0) AS contraction_rate,
    coalesce(n_quoted / nullif(quoted.n_words, 0), 0.0) AS dialogue_narration_ratio
  FROM source LEFT JOIN lexical USING (work_id) LEFT JOIN richness USING (work_id) LEFT JOIN rhythm USING (work_id)
    LEFT JOIN trees USING (work_id) LEFT JOIN punctuation USING (work_id) LEFT JOIN contractions USING (work_id)
    LEFT JOIN quoted USING (work_id) LEFT JOIN speech USING (work_id)),
tidy AS (SELECT * FROM wide UNPIVOT (value FOR metric IN (COLUMNS(* EXCLUDE (work_id)))))"""

CONCEPT = """CASE WHEN metric LIKE 'funcword_%' THEN 'function_word_frequency' WHEN metric LIKE 'punct_%' THEN 'punctuation_frequency'
  WHEN metric LIKE 'senttype_%' THEN 'sentence_type_mix' ELSE metric END"""
NORMALIZED = f"""
normalized AS (
  SELECT work_id, md5({CONCEPT}) AS metric_key, metric AS metric_name, value,
    (value - avg(value) OVER (PARTITION BY metric)) / nullif(stddev_pop(value) OVER (PARTITION BY metric), 0) AS zscore
  FROM tidy)"""
FACT = """
fact AS (
  SELECT md5(work_id || chr(31) || metric_name) AS measurement_key, md5(work_id) AS work_key, md5(author) AS author_key,
    metric_key, metric_name, value, zscore
  FROM normalized JOIN catalogue USING (work_id))"""
MART = """
mart AS (
  SELECT md5(work_id) AS work_key, work_id, title, md5(author) AS author_key, author,
""" + ",\n".join(f"    max(CASE WHEN metric_name = '{s}' THEN zscore END) AS \"{s}\"" for s in sorted(ALL_SERIES)) + """
  FROM normalized JOIN catalogue USING (work_id) GROUP BY work_id, title, author)"""

# A term has an owner flag and the others who use it; every other author's row counts terms in both and in either.
JACCARD = """
owned AS (
  SELECT term, bool_or(is_self) AS mine, list(DISTINCT author) FILTER (WHERE NOT is_self) AS users
  FROM vocab JOIN catalogue USING (work_id) GROUP BY term),
writers AS (SELECT DISTINCT unnest(users) AS author FROM owned),
seen AS (SELECT author, mine, coalesce(list_contains(users, author), false) AS theirs FROM owned CROSS JOIN writers),
overlap AS (
  SELECT md5(author) AS author_key, CAST(count_if(mine) AS BIGINT) AS my_vocab_size, CAST(count_if(theirs) AS BIGINT) AS their_vocab_size,
    CAST(count_if(mine AND theirs) AS BIGINT) AS shared_terms,
    count_if(mine AND theirs)::DOUBLE / count_if(mine OR theirs)::DOUBLE AS jaccard
  FROM seen GROUP BY author)"""

WHOLE = (*ALL_PARTS, TIDY, NORMALIZED, CATALOGUE, FACT)


def band(count: str) -> str:
    rules = " ".join(f"WHEN {count} < {below} THEN '{name}'" for name, below in BANDS)
    return f"CASE {rules} ELSE 'novel' END"


DIM_WORK = f"""
counted AS (SELECT source.work_id, {number('is_alpha')} AS word_count FROM source JOIN tok USING (work_id) GROUP BY ALL),
measured AS (
  SELECT * FROM counted WHERE work_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)),
dim_work AS (
  SELECT md5(work_id) AS work_key, md5(author) AS author_key, work_id, title, word_count, {band("word_count")} AS prose_type
  FROM catalogue LEFT JOIN measured USING (work_id))"""

def paragraphs(source: str) -> str:
    return rf"""
source AS ({source}),
parts AS (SELECT work_id, regexp_split_to_array(text, '\n{BLANK}*\n') AS parts FROM source),
paras AS (SELECT work_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS paragraph_no FROM parts)"""


PARAGRAPHS = paragraphs(SPACED)
# One paragraph after the other: (chunk, size) carried along.
PACKED = f""",
packed AS (
  SELECT work_id, paragraph_no, text, 0 AS chunk_no, length(text) + 2 AS size FROM paras WHERE paragraph_no = 0
  UNION ALL
  SELECT p.work_id, p.paragraph_no, p.text,
    CASE WHEN k.size + length(p.text) > {CHUNK_CHARS} THEN k.chunk_no + 1 ELSE k.chunk_no END,
    CASE WHEN k.size + length(p.text) > {CHUNK_CHARS} THEN 0 ELSE k.size END + length(p.text) + 2
  FROM packed k JOIN paras p ON p.work_id = k.work_id AND p.paragraph_no = k.paragraph_no + 1),
chunked AS (
  SELECT work_id, CAST(chunk_no AS INTEGER) AS chunk_no, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_no) AS text
  FROM packed GROUP BY ALL)"""

CHUNKS = PARAGRAPHS + PACKED

BRANDS = """
brands AS (
  SELECT p_brand AS metric_name, max(p_type) AS display_name, min(p_type) AS category, CAST(max(p_size) AS VARCHAR) AS unit
  FROM part GROUP BY p_brand),
dim_metric AS (
  SELECT md5(metric_name) AS metric_key, metric_name, display_name, category, unit, 'more' AS higher_means,
    'a brand' AS description, 'n' AS formula, unit > '3' AS is_multivalue, 'non-additive' AS additivity FROM brands)"""

ROUNDED = "round(value, 6) AS value"
TIDY_SELECT = f"SELECT work_id, metric, {ROUNDED} FROM tidy"


def spread_over(columns) -> str:
    """Zeros for works without tokens."""
    return ", ".join(f'coalesce("{c}", 0.0) AS "{c}"' for c in columns)


# The pooled texts of every group, a row per work and level.
GROUPS = """
documented AS (SELECT CAST(doc_id AS VARCHAR) AS work_id, source AS author, lang FROM documents),
groups AS (
  SELECT work_id, 'work' AS level, work_id AS key FROM documented UNION ALL SELECT work_id, 'author', author FROM documented
  UNION ALL SELECT work_id, 'language', lang FROM documented UNION ALL SELECT work_id, 'total', '' FROM documented)"""
POOLED = f"""
members AS (SELECT level, key, count(*) AS n_works FROM groups GROUP BY ALL),
by_word AS (
  SELECT level, key, count(*) AS big_n, sum(length(text)) AS letters, count_if(lower IN ({sql_list(ARCHAIC_WORDS)})) AS archaic
  FROM tok JOIN groups USING (work_id) WHERE is_alpha GROUP BY ALL),
by_term AS (SELECT level, key, lower, count(*) AS n FROM tok JOIN groups USING (work_id) WHERE is_alpha GROUP BY ALL),
by_type AS (SELECT level, key, CAST(sum(n * n) AS BIGINT) AS s2, count(*) AS v, count_if(n = 1) AS v1 FROM by_term GROUP BY ALL),
by_sentence AS (SELECT level, key, avg(n) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(n) ELSE 0.0 END AS dev FROM lengths JOIN groups USING (work_id) GROUP BY ALL)"""

# The marts with the faults of the query, and what each check finds in them.
with open(METRICS_FILE, encoding="utf-8", newline="") as _file:
    SEED_METRICS = ", ".join(f"('{r['metric_name']}', '{r['additivity']}')" for r in csv.DictReader(_file))
FAULTY = f"""
t_dim_metric AS (SELECT md5(name) AS metric_key, additivity FROM (VALUES {SEED_METRICS}) m(name, additivity)),
t_dim_author AS (SELECT DISTINCT md5(author) AS author_key FROM catalogue WHERE author <> '{SUSPECT}'),
t_dim_work AS (
  SELECT md5(work_id) AS work_key, md5(author) AS author_key, CASE WHEN title NOT LIKE '%3' THEN coalesce(n_words, 0) END AS word_count,
    CASE WHEN title LIKE '%7' THEN 'poem' WHEN n_words >= 40000 THEN 'novel' WHEN n_words >= 10000 THEN 'novella' ELSE 'short-story' END AS prose_type
  FROM catalogue LEFT JOIN words USING (work_id)),
t_fact_style_measurement AS MATERIALIZED (
  SELECT * FROM fact WHERE NOT (author_key = md5('{SUSPECT}') AND metric_name = 'contraction_rate')
  UNION ALL SELECT * FROM fact WHERE metric_name = 'yules_k' AND NOT (author_key = md5('{SUSPECT}') AND metric_name = 'contraction_rate')),
t_int_measurements_normalized AS (
  SELECT CASE WHEN metric_name = 'yules_k' THEN 'lost' WHEN metric_name <> 'honore_r' THEN metric_key END AS metric_key FROM normalized),
t_int_vocab_jaccard AS (SELECT author_key, jaccard + CASE WHEN author_key < '8' THEN 1 ELSE 0 END AS jaccard FROM overlap),
t_fact_vocab_overlap AS (
  SELECT md5(md5('src0') || chr(31) || author_key) AS overlap_key, md5('src0') AS author_key_a, author_key AS author_key_b, jaccard FROM overlap),
t_mart_work_fingerprint AS (SELECT md5(work_id) AS work_key, md5(author) AS author_key FROM catalogue)"""


def violations(kind: str, table: str, column: str, arguments: tuple) -> str:
    """SQL that counts what a check finds."""
    table = f"t_{table}"
    if kind == "not_null":
        found = f"SELECT count(*) FROM {table} WHERE {column} IS NULL"
    elif kind == "unique":
        found = f"SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    elif kind == "accepted_values":
        found = f"SELECT count(DISTINCT {column}) FROM {table} WHERE {column} NOT IN ({sql_list(arguments[0])})"
    elif kind == "accepted_range":
        found = f"SELECT count(*) FROM {table} WHERE NOT {column} BETWEEN {arguments[0]} AND {arguments[1]}"
    elif kind == "relationships":
        parent, field = arguments
        found = f"SELECT count(DISTINCT {column}) FROM {table} WHERE {column} NOT IN (SELECT {field} FROM t_{parent})"
    else:
        found = f"SELECT count(*) FROM (SELECT {column} FROM {table} GROUP BY 1 HAVING count(DISTINCT {arguments[0]}) <> {arguments[1]})"
    return f"SELECT '{kind}' AS kind, '{table[2:]}' AS table_name, '{column}' AS column_name, ({found}) AS violations"


ORACLES = {
    "clean_documents": f"SELECT work_id, md5(text) AS digest, length(text) AS n_chars FROM (SELECT work_id, {cleaned('text')} AS text FROM ({MARKED}))",
    "clean_long_works": f"SELECT work_id, md5(text) AS digest, length(text) AS n_chars FROM (SELECT work_id, {cleaned('text')} AS text FROM ({SOURCES}))",
    "assemble_chapters": TALKS,
    "files_to_works": f"""SELECT work_id, md5(text) AS digest, length(text) AS n_chars
      FROM (SELECT 'd' || work_id AS work_id, text FROM ({MARKED}) UNION ALL SELECT 'c' || work_id, text FROM ({TALKS}))""",
    "long_work_tokens": query(
        tokens(SOURCES),
        select="SELECT work_id, sent_no, count(*) AS n_tokens, min(tok_no) AS first_token, max(sent_tok_no) AS last_in_sentence, "
        "md5(string_agg(text, ' ' ORDER BY sent_tok_no)) AS digest FROM tok GROUP BY work_id, sent_no",
    ),
    "long_work_types": query(tokens(SOURCES), TYPES, select="SELECT work_id, term, n FROM types"),
    "long_work_measures": query(
        tokens(SOURCES), TYPES, LEXICAL, RHYTHM, PUNCTUATION, CONTRACTIONS, QUOTES,
        select="SELECT source.work_id, round(yules_k, 6) AS yules_k, round(honore_r, 6) AS honore_r, round(sentence_length_stdev, 6) AS sentence_length_stdev, "
        "n_clitics / contractions.n_words AS contraction_rate, n_quoted / quoted.n_words AS dialogue_narration_ratio, "
        + ", ".join(f'"{s}"::DOUBLE AS "{s}"' for s in SURFACE if s not in ("yules_k", "honore_r", "sentence_length_stdev", "contraction_rate", "dialogue_narration_ratio"))
        + " FROM source JOIN richness USING (work_id) JOIN lexical USING (work_id) JOIN rhythm USING (work_id) JOIN punctuation USING (work_id)"
        " JOIN contractions USING (work_id) JOIN quoted USING (work_id)",
    ),
    "split_paragraphs": query(PARAGRAPHS, select="SELECT work_id, CAST(paragraph_no AS INTEGER) AS paragraph_no, md5(text) AS digest FROM paras"),
    "chunk_paragraphs": query(CHUNKS, select="SELECT work_id, chunk_no, length(text) AS n_chars, md5(text) AS digest FROM chunked"),
    "chunk_long_works": query(
        paragraphs(SPACED_SOURCES) + PACKED, select="SELECT work_id, chunk_no, length(text) AS n_chars, md5(text) AS digest FROM chunked"
    ),
    "sentence_token_lists": query(
        tokens(),
        select=f"SELECT work_id, sent_no, count(*) AS n_tokens, {number('is_alpha')} AS n_words, {number('is_punct')} AS n_marks, "
        "md5(string_agg(text, ' ' ORDER BY sent_tok_no)) AS digest FROM tok GROUP BY work_id, sent_no",
    ),
    "word_counts": query(tokens(), WORDS, select="SELECT * FROM words"),
    "type_frequencies": query(tokens(), TYPES, select="SELECT work_id, term, n FROM types"),
    "lexical_metrics": query(
        tokens(), TYPES, LEXICAL,
        select="SELECT richness.work_id, round(yules_k, 6) AS yules_k, round(honore_r, 6) AS honore_r, "
        + spread_over(["mean_word_length", "archaic_word_rate", *(f"funcword_{w}" for w in FUNCTION_WORDS)])
        + " FROM richness LEFT JOIN lexical USING (work_id)",
    ),
    "sentence_metrics": query(
        tokens(), RHYTHM,
        select="SELECT source.work_id, coalesce(mean_sentence_length, 0.0) AS mean_sentence_length, "
        "round(coalesce(sentence_length_stdev, 0.0), 6) AS sentence_length_stdev FROM source LEFT JOIN rhythm USING (work_id)",
    ),
    "punctuation_rates": query(
        tokens(PAGES, clean=False), PUNCTUATION,
        select="SELECT source.work_id, " + spread_over([f"punct_{g}" for g in PUNCTUATION_GROUPS]) + " FROM source LEFT JOIN punctuation USING (work_id)",
    ),
    "contraction_rate": query(
        tokens(CONTRACTED), CONTRACTIONS,
        select="SELECT source.work_id, coalesce(n_words, 0) AS n_words, coalesce(n_clitics, 0) AS n_clitics, "
        "coalesce(n_clitics / nullif(n_words, 0), 0.0) AS contraction_rate FROM source LEFT JOIN contractions USING (work_id)",
    ),
    "tagged_contractions": query(
        tokens(CONTRACTED),
        "tagged AS (SELECT *, lower IN ('''s', '’s') AND tok_no % 2 = 0 AS possessive, replace(lower, '’', '''') AS clitic FROM tok)",
        select="""SELECT work_id, CAST(count_if(is_alpha) AS BIGINT) AS n_words,
          CAST(count_if(clitic IN ('n''t', '''re', '''ve', '''ll', '''m', '''d') OR (clitic = '''s' AND NOT possessive)) AS BIGINT) AS n_clitics,
          coalesce(count_if(clitic IN ('n''t', '''re', '''ve', '''ll', '''m', '''d') OR (clitic = '''s' AND NOT possessive)) / nullif(count_if(is_alpha), 0), 0.0) AS contraction_rate
          FROM tagged GROUP BY work_id""",
    ),
    "dialogue_ratio": query(
        tokens(PAGES, clean=False), QUOTES,
        select="SELECT source.work_id, coalesce(n_words, 0) AS n_words, coalesce(n_quoted, 0) AS n_quoted, "
        "coalesce(n_quoted / nullif(n_words, 0), 0.0) AS dialogue_narration_ratio FROM source LEFT JOIN quoted USING (work_id)",
    ),
    "tree_depth": query(tokens(), LABELS, TREES, select="SELECT work_id, n_parsed_sentences, mean_parse_tree_depth FROM trees"),
    "sentence_types": query(
        tokens(), LABELS, TREES, select="SELECT work_id, senttype_simple, senttype_compound, senttype_complex FROM trees"
    ),
    "pos_densities": query(tokens(), LABELS, SPEECH, select="SELECT * FROM speech"),
    "vocabulary": query(tokens(), LABELS, VOCABULARY, select="SELECT * FROM vocab"),
    "lexicon_lookup": query(
        tokens(), LABELS,
        "known AS (WITH " + tokens(BENCHMARK) + " SELECT DISTINCT lower FROM tok WHERE is_alpha)",
        select="SELECT work_id, CASE WHEN k.lower IS NULL THEN pos ELSE 'PROPN' END AS pos, count(*) AS n, "
        "count(DISTINCT CASE WHEN k.lower IS NULL THEN lemma ELSE upper(k.lower) END) AS n_lemmas, "
        "CAST(count_if(k.lower IS NULL AND is_stop) AS BIGINT) AS n_stop FROM tagged t LEFT JOIN known k ON t.lower = k.lower GROUP BY 1, 2",
    ),
    "annotate_chunks": rf"""
WITH RECURSIVE source AS ({SPACED}),
prose AS (SELECT work_id, {cleaned('text')} AS text FROM source),
marked AS (
  SELECT work_id, list_filter(string_split(regexp_replace(text, '([.!?…])[\s\pZ]+|\n{BLANK}*\n', '\1' || chr(31), 'g'), chr(31)),
    lambda s: regexp_matches(s, '{FILLED}')) AS parts FROM prose),
sent AS (SELECT work_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS sent_no FROM marked),
listed AS (SELECT work_id, sent_no, regexp_extract_all(text, '\pL+|\pN+|--|\.\.\.|[^\s\pZ\pL\pN]') AS parts FROM sent),
placed AS (SELECT work_id, sent_no, unnest(parts) AS text, generate_subscripts(parts, 1) AS place FROM listed),
tok AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY sent_no, place) AS tok_no FROM placed)
SELECT work_id, count(*) AS n_tokens, max(tok_no) AS last_token, CAST(max(sent_no) AS INTEGER) AS last_sentence,
  CAST(sum(tok_no * length(text)) AS BIGINT) AS position_sum, CAST(sum(sent_no * length(text)) AS BIGINT) AS sentence_sum
FROM tok GROUP BY work_id""",
    "tidy_measurements": query(*ALL_PARTS, TIDY, select=TIDY_SELECT),
    "token_table_measurements": query(*ALL_PARTS, TIDY, select=TIDY_SELECT),
    "staged_works": query(tokens(), WORDS, select=f"SELECT work_id, n_words AS word_count, {LOADED_AT} AS loaded_at FROM words"),
    "staged_measurements": query(
        *ALL_PARTS, TIDY, select=f"SELECT work_id, metric AS metric_name, {ROUNDED}, {LOADED_AT} AS loaded_at FROM tidy"
    ),
    "staged_vocab": query(tokens(), LABELS, VOCABULARY, select=f"SELECT *, {LOADED_AT} AS loaded_at FROM vocab"),
    "raw_landing": query(
        *ALL_PARTS, TIDY, WORDS, VOCABULARY,
        select=f"""SELECT table_name, {LOADED_AT} AS loaded_at, count(*) AS n_rows, count(DISTINCT work_id) AS n_works,
          CAST(sum(amount) AS BIGINT) AS amount FROM (
            SELECT 'raw_works' AS table_name, work_id, n_words AS amount FROM words
            UNION ALL SELECT 'raw_measurements', work_id, 1 FROM tidy
            UNION ALL SELECT 'raw_vocab', work_id, term_count FROM vocab) GROUP BY table_name""",
    ),
    "seed_tables": query(CATALOGUE, select="SELECT * FROM catalogue"),
    "seed_manifest": query(CATALOGUE, select="SELECT work_id, path FROM catalogue"),
    "zscore_by_metric": """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
      round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 6) AS zscore
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""",
    "normalized_measurements": query(
        *ALL_PARTS, TIDY, NORMALIZED, select=f"SELECT work_id, metric_key, metric_name, {ROUNDED}, round(zscore, 6) AS zscore FROM normalized"
    ),
    "dim_author": "SELECT DISTINCT md5(source) AS author_key, source AS name, 'test' AS tradition, 'now' AS era, source = 'src0' AS is_self FROM documents",
    "dim_author_conflicts": "SELECT md5(source) AS value, count(DISTINCT lang) AS n_rows FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
    "dim_metric": query(BRANDS, select="SELECT * FROM dim_metric"),
    "dim_work": query(tokens(), CATALOGUE, DIM_WORK, select="SELECT * FROM dim_work"),
    "vocab_jaccard": query(tokens(), LABELS, VOCABULARY, CATALOGUE, JACCARD, select="SELECT * FROM overlap"),
    "fact_vocab_overlap": query(
        tokens(), LABELS, VOCABULARY, CATALOGUE, JACCARD,
        select="SELECT md5(md5('src0') || chr(31) || author_key) AS overlap_key, md5('src0') AS author_key_a, author_key AS author_key_b, "
        "my_vocab_size, their_vocab_size, shared_terms, jaccard FROM overlap",
    ),
    "fact_style_measurement": query(
        *WHOLE,
        select=f"SELECT measurement_key, work_key, author_key, metric_key, metric_name, {ROUNDED}, round(zscore, 6) AS zscore FROM fact",
    ),
    "mart_work_fingerprint": query(
        *WHOLE, MART,
        select="SELECT work_key, work_id, title, author_key, author, " + ", ".join(f'round("{s}", 6) AS "{s}"' for s in ALL_SERIES) + " FROM mart",
    ),
    "vocab_cosine": query(
        tokens(), LABELS, VOCABULARY, CATALOGUE, """
held AS (
  SELECT work_id, author, term, term_count FROM (SELECT * FROM vocab UNION ALL SELECT work_id, 'everywhere', 3 FROM source) JOIN catalogue USING (work_id)),
idfs AS (SELECT term, ln((SELECT count(DISTINCT work_id) FROM held)::DOUBLE / count(DISTINCT work_id)) AS idf FROM held GROUP BY term),
weights AS (SELECT author, term, sum(term_count) * any_value(idf) AS w FROM held JOIN idfs USING (term) GROUP BY ALL),
mine AS (SELECT term, w FROM weights WHERE author = 'src0')""",
        select="""SELECT md5(o.author) AS author_key, CAST(count_if(o.w <> 0 AND m.w <> 0) AS BIGINT) AS shared_terms,
          round(sum(o.w * m.w) / nullif(sqrt(sum(o.w * o.w)) * (SELECT sqrt(sum(w * w)) FROM mine), 0), 6) AS cosine
          FROM weights o LEFT JOIN mine m USING (term) WHERE o.author <> 'src0' GROUP BY o.author""",
    ),
    "pooled_levels": query(
        tokens(), RHYTHM, GROUPS, POOLED,
        select="""SELECT level, key, n_works, round(coalesce(letters / big_n, 0.0), 6) AS mean_word_length, round(coalesce(archaic / big_n, 0.0), 6) AS archaic_word_rate,
          round(coalesce(10000.0::DOUBLE * (s2 - big_n) / (big_n::DOUBLE * big_n), 0.0), 6) AS yules_k,
          round(CASE WHEN v1 < v THEN 100.0::DOUBLE * ln(big_n) / (1 - v1 / v) ELSE 0.0 END, 6) AS honore_r,
          round(coalesce(mean, 0.0), 6) AS mean_sentence_length, round(coalesce(dev, 0.0), 6) AS sentence_length_stdev
          FROM members LEFT JOIN by_word USING (level, key) LEFT JOIN by_type USING (level, key) LEFT JOIN by_sentence USING (level, key)""",
    ),
    "sentence_histogram": query(
        tokens(), RHYTHM, GROUPS,
        "sized AS (SELECT author, n, CAST(n // 5 * 5 AS BIGINT) AS bucket FROM lengths JOIN documented USING (work_id))",
        "spans AS (SELECT author, unnest(range(0, max(bucket) + 5, 5)) AS bucket FROM sized GROUP BY author)",
        select="SELECT s.author, CAST(s.bucket AS BIGINT) AS bucket, count(n) AS n FROM spans s LEFT JOIN sized z ON z.author = s.author AND z.bucket = s.bucket GROUP BY 1, 2",
    ),
    "sentence_quantiles": query(
        tokens(), RHYTHM, GROUPS,
        "sorted AS (SELECT author, list(n ORDER BY n) AS l FROM lengths JOIN documented USING (work_id) GROUP BY author)",
        select="SELECT author, len(l) AS n_sentences, CAST(l[ceil(len(l) * 0.1)::INTEGER] AS BIGINT) AS q10, CAST(l[ceil(len(l) * 0.5)::INTEGER] AS BIGINT) AS median, "
        "CAST(l[ceil(len(l) * 0.9)::INTEGER] AS BIGINT) AS q90, CAST(l[len(l)] AS BIGINT) AS longest FROM sorted",
    ),
    "mart_check_counts": query(
        *WHOLE, WORDS, VOCABULARY, JACCARD, FAULTY, select=" UNION ALL ".join(violations(c.kind, c.table, c.column, c.arguments) for c in MART_CHECKS)
    ),
    "appended_scores": query(
        *ALL_PARTS, TIDY, "loaded AS (SELECT work_id, metric, CASE WHEN work_id::BIGINT % 30 = 0 THEN value * 2 ELSE value END AS value FROM tidy)",
        select=f"""SELECT work_id, metric, {ROUNDED}, round((round(value, 9) - avg(round(value, 9)) OVER w) / nullif(stddev_pop(round(value, 9)) OVER w, 0), 6) AS zscore
          FROM loaded WINDOW w AS (PARTITION BY metric)""",
    ),
    "appended_terms": query(
        tokens(), LABELS, VOCABULARY, CATALOGUE,
        select="SELECT author, term, count(*) AS n_works, CAST(sum(CASE WHEN work_id::BIGINT % 30 = 0 THEN 2 * term_count ELSE term_count END) AS BIGINT) AS n "
        "FROM vocab JOIN catalogue USING (work_id) GROUP BY author, term",
    ),
    "pivot_by_values": """SELECT o_custkey, """
    + ", ".join(
        f"max(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END) AS \"{p.lower().replace(' ', '_').replace('-', '_')}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " FROM orders GROUP BY o_custkey",
    "check_unique": "SELECT o_custkey AS value, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "check_not_null": query(tokens(), CATALOGUE, DIM_WORK, select="SELECT work_key, work_id FROM dim_work WHERE word_count IS NULL"),
    "check_accepted_values": "SELECT l_returnflag AS value, count(*) AS n_rows FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY l_returnflag",
    "check_relationships": """SELECT l_orderkey AS value, count(*) AS n_rows FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY l_orderkey""",
    "check_range": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT (l_discount BETWEEN 0.02 AND 0.08)",
    "check_concepts": query(
        *WHOLE,
        select=f"""SELECT work_key, count(DISTINCT metric_key) AS n_distinct FROM fact
          WHERE NOT (author_key = md5('{SUSPECT}') AND metric_name = 'contraction_rate')
          GROUP BY work_key HAVING count(DISTINCT metric_key) <> 14""",
    ),
    "report_authors": query(*WHOLE, select="SELECT DISTINCT author FROM fact JOIN catalogue ON work_key = md5(work_id)"),
    "report_metrics": query(BRANDS, select="SELECT DISTINCT metric_name FROM dim_metric"),
    "report_works": query(
        *WHOLE, MART,
        select="SELECT title, author, round(mean_word_length, 6) AS mean_word_length, round(mean_sentence_length, 6) AS mean_sentence_length, "
        "round(adjective_density, 6) AS adjective_density, round(yules_k, 6) AS yules_k FROM mart WHERE author LIKE 'src1%'",
    ),
    "report_author_metrics": query(
        *WHOLE,
        "metric AS (SELECT unnest([" + sql_list(CHOSEN_METRICS) + "]) AS metric_name)",
        select="""SELECT a.author, m.metric_name, round(avg(f.value), 6) AS value, round(avg(f.zscore), 6) AS zscore
          FROM fact f JOIN metric m ON f.metric_key = md5(m.metric_name)
          JOIN (SELECT DISTINCT author FROM catalogue) a ON f.author_key = md5(a.author)
          WHERE a.author LIKE 'src%' GROUP BY a.author, m.metric_name""",
    ),
    "report_first_page": "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
}
ORACLES["published_marts"] = ORACLES["mart_work_fingerprint"]
