"""The registered queries over the documents, pages and conversations tables, and the SQL
that gives the same rows. Python's and Java's Unicode classes are mirrored in SQL by a mask:
every non-ASCII character, all of which are letters in these tables, becomes "_", which is a
word character too and keeps every position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import rules
from inkmill.functions import text as tx
from inkmill.operators import correct, lint, quality, segment, structure, tables
from inkmill.plans import pipeline, render
from inkmill.sources.files import html_text, markdown_text, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents", *columns: str) -> DataFrame:
    columns = columns or ("doc_id", "text")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), columns[0])


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MASK = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents"
CLEAN_LINES = f"SELECT doc_id, line_no, regexp_replace({TRIM.format('raw')}, '\\s+', ' ', 'g') AS text FROM ({LINES})"
#: Cleaned lines, those over 2000 characters as their sentences packed greedily; for WITH RECURSIVE.
SPLIT_LINES = rf"""cleaned AS (SELECT doc_id, line_no, text FROM ({CLEAN_LINES}) WHERE text <> ''),
sentences AS (SELECT doc_id, line_no, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM cleaned WHERE length(text) > 2000),
packed AS (SELECT doc_id, line_no, s, 1 AS i, 1 AS part, length(s[1]) + (length(s[1]) + 1 <= 2000)::INT AS n FROM sentences
  UNION ALL SELECT doc_id, line_no, s, i + 1, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN n + more + 1 ELSE more END
  FROM (SELECT *, length(s[i + 1]) AS more, n + length(s[i + 1]) + 1 <= 2000 AS fits FROM packed WHERE i < len(s))),
split_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS line_no, text FROM (
  SELECT doc_id, line_no, 0 AS part, text FROM cleaned WHERE length(text) <= 2000
  UNION ALL SELECT doc_id, line_no, part, string_agg(s[i], ' ' ORDER BY i) FROM packed GROUP BY doc_id, line_no, part))"""
LEXICON = "(VALUES " + ", ".join(f"({_lit(w)})" for w in sorted({*rules.STARTER_WORDS, *rules.GAME_TERMS})) + ") lex(word)"
TOKENS = r"""SELECT doc_id, pos, token FROM (
  SELECT doc_id, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM documents))
  WHERE length(token) >= 3"""


CORRECTOR = "(VALUES " + ", ".join(f"({_lit(w)})" for w in sorted({*rules.COMMON_WORDS, *rules.GAME_TERMS})) + ") lex(word)"
_FIX = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(token, '[^\\x00-\\x7F]', '_', 'g'), {_lit('^(?:' + p + ')')}) THEN {_lit(by)}" for p, by in rules.OCR_REPAIRS) + " END"
#: The longest common part of x and y, of equal ones the first in x, then in y; k is its length.
_BEST = """list_reverse_sort(flatten(list_transform(generate_series(1, length(x)), lambda i: list_transform(generate_series(1, length(y)), lambda j:
  {'k': len(list_filter(generate_series(1, least(length(x) - i + 1, length(y) - j + 1)), lambda n: substring(x, i, n) = substring(y, j, n))), 'i': -i, 'j': -j}))))[1]"""


def _corrections_sql(tokens: str) -> str:
    """CTEs from a table of distinct tokens to corrections (token, corrected, confidence): the
    ratio is twice the length of what two words have in common, by longest parts first."""
    return f"""open AS (SELECT token, lower(token) AS a, {_FIX} AS fix FROM {tokens} WHERE length(token) >= 3 AND lower(token) NOT IN (SELECT word FROM {CORRECTOR})),
seg AS (SELECT token, word, a AS x, word AS y FROM open JOIN {CORRECTOR} ON left(a, 2) = left(word, 2) AND abs(length(word) - length(token)) <= 2
    WHERE fix IS NULL AND length(token) <= 20 AND levenshtein(a, word) <= 0.2 * (length(token) + length(word)) + strlen(a) - length(a)
  UNION ALL SELECT token, word, part.x, part.y FROM (
    SELECT token, word, unnest([{{'x': substring(x, 1, -b.i - 1), 'y': substring(y, 1, -b.j - 1)}}, {{'x': substring(x, b.k - b.i), 'y': substring(y, b.k - b.j)}}]) AS part
    FROM (SELECT token, word, x, y, {_BEST} AS b FROM seg) WHERE b.k > 0) WHERE part.x <> '' AND part.y <> ''),
ratio AS (SELECT token, word, 2.0 * sum(b.k) / (length(token) + length(word)) AS r FROM (SELECT token, word, {_BEST} AS b FROM seg) GROUP BY token, word),
near AS (SELECT token, word, r, row_number() OVER (PARTITION BY token ORDER BY r DESC, word) AS n FROM ratio WHERE r > 0.8),
best AS (SELECT token, coalesce(fix, CASE WHEN regexp_matches(token, '^\\p{{Lu}}') THEN upper(left(word, 1)) || substring(word, 2) ELSE word END, token) AS c, CASE WHEN fix IS NOT NULL THEN 0.95 ELSE coalesce(r, 1.0) END AS conf
  FROM open LEFT JOIN (SELECT * FROM near WHERE n = 1) USING (token)),
corrections AS (SELECT token, coalesce(c, token) AS corrected, coalesce(conf, 1.0)::DOUBLE AS confidence FROM {tokens} LEFT JOIN best USING (token))"""


# --- lines and normalisers --------------------------------------------------------------
@query(f"""SELECT doc_id, count(*) AS total_lines, avg(length(text)) AS avg_line_length, max(length(text)) AS max_line_length
FROM ({CLEAN_LINES}) WHERE text <> '' GROUP BY doc_id""")
def line_stats_unsplit(spark, sf_dir):
    return segment.document_line_stats(_docs(spark, sf_dir), split_long=False)


@query(f"""SELECT doc_id, line_no, length(text) AS n_chars FROM ({CLEAN_LINES}) WHERE text <> ''""")
def cleaned_lines(spark, sf_dir):
    """One row per line: the exploded form on which the segmentation works."""
    return segment.split_lines(_docs(spark, sf_dir), split_long=False).select("doc_id", "line_no", F.length("text").alias("n_chars"))


@query(f"""WITH RECURSIVE {SPLIT_LINES} SELECT doc_id, count(line_no) AS total_lines, coalesce(avg(length(l.text)), 0) AS avg_line_length, coalesce(max(length(l.text)), 0) AS max_line_length
FROM documents LEFT JOIN split_lines l USING (doc_id) GROUP BY doc_id""")
def line_stats(spark, sf_dir):
    return segment.document_line_stats(_docs(spark, sf_dir))


@query(rf"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(
  regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '\n', chr(10)), '\r\n|\r', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '•', chr(10) || '•'), '([.!?])\s*([A-Z])', '\1' || chr(10) || '\2', 'g'),
  chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> ''), chr(10))) AS text_md5 FROM documents""")
def clean_extracted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.clean_extracted_text("text")).alias("text_md5"))


def _chain(table, x=MASK):
    for p, by in table:
        x = f"regexp_replace({x}, {_lit(p)}, {_lit(by)}, 'g')"
    return x


@query(f"SELECT doc_id, md5({_chain(rules.COMMON_SPACING)}) AS text_md5 FROM documents")
def common_spacing(spark, sf_dir):
    """On the masked text, so that both sides hash the same."""
    masked = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.fix_common_spacing(masked)).alias("text_md5"))


@query(f"SELECT doc_id, md5({_chain(rules.OCR_REPAIRS)}) AS text_md5 FROM documents")
def ocr_repairs(spark, sf_dir):
    masked = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return _docs(spark, sf_dir).select("doc_id", F.md5(correct.repair_ocr(masked)).alias("text_md5"))


@query(rf"SELECT doc_id, md5({TRIM.format(_chain([(r'\s+', ' ')], 'text'))}) AS text_md5, length({TRIM.format(_chain([(r'\s+', ' ')], 'text'))}) < 100 AS scanned FROM documents")
def collapsed_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.collapse_space("text")).alias("text_md5"), tx.is_scanned(tx.collapse_space("text")).alias("scanned"))


@query()
def cleaned_paragraphs(spark, sf_dir):
    """Every line through the light cleaning: spaced words, terms, run-together words, spacing."""
    rows = segment.split_lines(_docs(spark, sf_dir))
    return rows.select("doc_id", "line_no", tx.clean_paragraph("text", "light", tx.run_together_fixer()).alias("text"))


@query()
def content_lines(spark, sf_dir):
    rows = segment.split_lines(_docs(spark, sf_dir))
    return rows.select("doc_id", "line_no", tx.clean_content_line("text", join_lower=False).alias("line"), tx.clean_content_text("text").alias("content"))


@query()
def structure_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.clean_text("text")).alias("clean_md5"), F.md5(tx.preprocess_text("text")).alias("preprocessed_md5"))


@query(r"""SELECT page_id, lower(replace(t, ' ', '-')) AS dashed, regexp_replace(lower(replace(t, ' ', '-')), '[^\p{L}\p{N}_-]', '', 'g') AS anchor
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def anchors(spark, sf_dir):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _docs(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.lower(F.replace(t, F.lit(" "), F.lit("-"))).alias("dashed"), tx.anchor(t).alias("anchor"))


_SINGLE = r"regexp_matches({}, '^\p{{L}}$')"
_SPACED = TRIM.format(r"regexp_replace(regexp_replace(z, '([a-z])([A-Z])', '\1 \2', 'g'), '[\s\-]+', ' ', 'g')")


@query(rf"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '([^/]*)/?$', 1) AS name FROM pages),
d AS (SELECT *, regexp_replace(regexp_replace(t, '\.{{2,}}.*?\d+$', ''), '\.{{3,}}', '', 'g') AS y FROM t),
c AS (SELECT *, list_filter(string_split_regex(y, '\s+'), lambda x: x <> '') AS w FROM d),
j AS (SELECT *, CASE WHEN contains(y, ' ') THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR {_SINGLE.format("x")} AND {_SINGLE.format("w[i - 1]")} THEN '' ELSE ' ' END || x), '') ELSE y END AS z FROM c),
k AS (SELECT *, replace({_SPACED}, 'D & D', 'D&D') AS v FROM j)
SELECT page_id, CASE WHEN t = '' THEN 'Untitled Section' ELSE array_to_string(list_transform(string_split(v, ' '), lambda x: CASE left(x, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left(x, 1)) END || lower(substring(x, 2))), ' ') END AS title,
  array_to_string(list_transform(regexp_extract_all(translate(regexp_replace(name, '(.)\.[^./\\]*$', '\1'), '_-', '  '), '\p{{L}}+|\P{{L}}+'), lambda r: upper(left(r, 1)) || lower(substring(r, 2))), '') AS name,
  TRY_CAST(regexp_extract(url, '\s*(\d+)\s*$', 1) AS INT) AS page FROM k""")
def titles(spark, sf_dir):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    name = F.regexp_extract("url", r"([^/]*)/?$", 1)
    return _docs(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", tx.normalize_title(t).alias("title"), tx.clean_filename(name).alias("name"), tx.page_number("url").alias("page"))


@query()
def html_texts(spark, sf_dir):
    return _docs(spark, sf_dir, "pages", "page_id", "html").select("page_id", html_text("html").alias("text"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace('# ' || role || chr(10) || text, '(?m)^#{1,6}[ \t]+', '', 'g')) AS text_md5 FROM conversations""")
def markdown_texts(spark, sf_dir):
    rows = _docs(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", F.md5(markdown_text(F.concat(F.lit("# "), "role", F.lit("\n"), "text"))).alias("text_md5"))


# --- quality ----------------------------------------------------------------------------
COLLAPSED = TRIM.format(_chain([(r"\s+", " ")], "text"))
METRICS = rf"""SELECT doc_id, len(w) AS word_count, CASE WHEN len(w) > 0 THEN (length(t) - len(w) + 1) / len(w)::DOUBLE ELSE 0.0 END AS avg_word_length,
  len(list_distinct(list_filter(regexp_extract_all(t, '(?s).'), lambda c: c <> ''))) AS unique_chars, regexp_matches(t, '[^\x00-\x7F]') AS non_ascii
FROM (SELECT doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {COLLAPSED} AS t FROM documents))"""


@query(METRICS)
def quality_metrics(spark, sf_dir):
    return quality.metrics(_docs(spark, sf_dir)).drop("cleaned_text")


@query(f"""SELECT doc_id, word_count < 50 AS few_words, avg_word_length < 2 AS short_words, avg_word_length > 15 AS long_words, non_ascii FROM ({METRICS})""")
def quality_issues(spark, sf_dir):
    found = quality.issues(_docs(spark, sf_dir))
    says = lambda t: F.exists("issues", lambda i: i.startswith(t))
    of_text = lambda c: F.when(F.col("word_count").isNotNull(), c)
    return found.select("doc_id", of_text(says("Text contains too few")).alias("few_words"), says("Average word length too short").alias("short_words"), says("Average word length too long").alias("long_words"), of_text(says("Non-ASCII")).alias("non_ascii"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_filter(l, lambda x, i: i % 2 = 1 AND i < len(l)) AS heads, list_filter(l, lambda x, i: i % 2 = 0) AS feet FROM l),
i AS (SELECT m.*, list_filter(flatten([[CASE WHEN word_count < 50 THEN 'Text contains too few words (' || word_count || ' < 50)' END,
    CASE WHEN avg_word_length < 2 THEN 'Average word length too short (' || printf('%.1f', avg_word_length) || ' < 2)' WHEN avg_word_length > 15 THEN 'Average word length too long (' || printf('%.1f', avg_word_length) || ' > 15)' END],
    list_transform(l, lambda x, i: CASE WHEN length(x) > 2000 THEN 'Line ' || i || ' exceeds maximum length (' || length(x) || ' > 2000)' END),
    [CASE WHEN len(l) >= 4 AND (len(list_distinct(heads)) = 1 AND len(heads) > 2 OR len(list_distinct(feet)) = 1 AND len(feet) > 2) THEN 'Detected possible header/footer repetition' END,
    CASE WHEN non_ascii THEN 'Non-ASCII characters detected' END]]), lambda x: x IS NOT NULL) AS issues FROM ({METRICS}) m JOIN h USING (doc_id))
SELECT doc_id, len(issues) = 0 AS is_valid, issues, word_count, avg_word_length, unique_chars FROM i""")
def quality_reports(spark, sf_dir):
    return quality.issues(_docs(spark, sf_dir), per_line=True)


@query("""SELECT quality, count(*) AS n, sum(CASE WHEN word_count < 50 THEN 1 ELSE 0 END) AS few_words FROM (""" + METRICS + """) JOIN labels USING (doc_id) GROUP BY quality""")
def quality_by_label(spark, sf_dir):
    m = quality.metrics(_docs(spark, sf_dir)).select("doc_id", "word_count")
    labels = _docs(spark, sf_dir, "labels", "doc_id", "quality")
    return m.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum((F.col("word_count") < 50).cast("int")).alias("few_words"))


# --- lint -------------------------------------------------------------------------------
def _counts_sql(table, ignore_case):
    flag = "(?i)" if ignore_case else ""
    each = [f"SELECT doc_id, {k} AS rule_no, len(regexp_extract_all(t, {_lit(flag + p)})) AS n FROM m" for k, (p, _, _) in enumerate(table)]
    return f"WITH m AS (SELECT doc_id, {MASK} AS t FROM documents) SELECT * FROM (" + " UNION ALL ".join(each) + ") WHERE n > 0"


@query(_counts_sql(rules.SPACING_RULES, False))
def lint_spacing_counts(spark, sf_dir):
    return lint.rule_counts(_docs(spark, sf_dir), rules.SPACING_RULES, False)


#: What no text of the tables has: one of them goes in front of every text.
_PHRASES = (
    "Character  sheet", "PLAYERS handbook", "dungeon master guide", "role play", "skill check and skill\ncheck", "saving throws", "hit point",
    "what ever", "which ever", "how ever", "When ever", "where ever", "who ever",
)
_JOINED = ("weuse", "Youcan and youhave", "youare", "youmay youmust", "youmight", "youshould", "youdo", "youget", "it'sa", "that'sgood", "it'sfine", "there'smore", "cat'spaw")


def _put_in(spark, sf_dir, parts):
    first = F.element_at(F.array(*[F.lit(p) for p in (*parts, "")]), (F.col("doc_id") % (len(parts) + 1) + 1).cast("int"))
    return _docs(spark, sf_dir).withColumn("text", F.concat(first, F.lit(" "), "text"))


def _put_in_sql(parts, table):
    listed = "[" + ", ".join(_lit(p) for p in (*parts, "")) + "]"
    return _counts_sql(table, True).replace("FROM documents", f"FROM (SELECT doc_id, {listed}[doc_id % {len(parts) + 1} + 1] || ' ' || text AS text FROM documents)", 1)


@query(_put_in_sql(_PHRASES, rules.PHRASE_RULES))
def lint_phrase_counts(spark, sf_dir):
    return lint.rule_counts(_put_in(spark, sf_dir, _PHRASES), rules.PHRASE_RULES, True)


@query(_put_in_sql(_JOINED, rules.WORD_JOIN_RULES))
def lint_joined_counts(spark, sf_dir):
    return lint.rule_counts(_put_in(spark, sf_dir, _JOINED), rules.WORD_JOIN_RULES, True)


@query(_counts_sql(rules.SPLIT_WORD_RULES, True))
def lint_split_counts(spark, sf_dir):
    return lint.rule_counts(_docs(spark, sf_dir), rules.SPLIT_WORD_RULES, True)


def _positions_sql(lints):
    each, groups = [], []
    for i, (kind, table, ignore_case) in enumerate(lints):
        flag = "(?i)" if ignore_case else ""
        for k, (p, by, conf) in enumerate(table):
            q = _lit(flag + p)
            if "\\1" in by:
                own = _lit("^" + flag + p.replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]") + "$")
                groups.append(f"WHEN lint = {i} AND rule_no = {k} THEN regexp_replace(hit, {own}, {_lit(by)})")
            each.append(f"SELECT doc_id, text, {conf} AS confidence, {i} AS lint, {_lit(kind)} AS error_type, {k} AS rule_no, {_lit(by)} AS repl, string_split_regex(t, {q}) AS gaps, regexp_extract_all(t, {q}) AS hits FROM m WHERE regexp_matches(t, {q})")
    return f"""WITH m AS (SELECT doc_id, text, {MASK} AS t FROM documents), e AS ({" UNION ALL ".join(each)}),
r AS (SELECT doc_id, text, confidence, lint, error_type, rule_no, repl, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(generate_series(0, len(hits) - 1)) AS match_no FROM e),
s AS (SELECT *, coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, lint, rule_no ORDER BY match_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start FROM r),
o AS (SELECT doc_id, lint, error_type, rule_no, match_no, start::BIGINT AS start, confidence, repl, substring(text, start::BIGINT + 1, length(hit)) AS hit FROM s),
p AS (SELECT doc_id, lint, error_type, rule_no, match_no, start, confidence, CASE {" ".join(groups)} ELSE repl END AS repl, hit AS text FROM o)"""


def _placed(rows: str) -> str:
    """rows (doc_id, start, ...) with line and column, from 0."""
    return f"""(SELECT r.*, len(string_split(left(d.text, r.start), chr(10))) - 1 AS line, length(string_split(left(d.text, r.start), chr(10))[-1]) AS "column", d.text AS whole FROM ({rows}) r JOIN documents d USING (doc_id))"""


@query(_positions_sql((("spacing", rules.SPACING_RULES, False),)) + f' SELECT doc_id, rule_no, match_no, start, line, "column", text FROM {_placed("SELECT * FROM p")}')
def lint_positions(spark, sf_dir):
    return lint.scan(_docs(spark, sf_dir), rules.SPACING_RULES, False, ("doc_id",)).select("doc_id", "rule_no", "match_no", "start", "line", "column", "text")


_ERRORS = _positions_sql(lint.MARKDOWN).replace("WITH m", "WITH RECURSIVE m", 1) + rf""",
tok AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS token FROM documents) WHERE length(token) >= 3), {_corrections_sql("tok")},
w AS (SELECT doc_id, text, unnest(string_split_regex(t, '\w+')[1:len(regexp_extract_all(t, '\w+'))]) AS gap, unnest(regexp_extract_all(t, '\w+')) AS hit, unnest(generate_series(1, len(regexp_extract_all(t, '\w+')))) AS k FROM m),
v AS (SELECT doc_id, text, k, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit) AS start FROM w),
word AS (SELECT v.*, token, corrected, confidence FROM v JOIN corrections ON substring(text, start::BIGINT + 1, n) = token WHERE corrected <> token AND confidence >= 0.85),
q AS (SELECT doc_id, lint, error_type, rule_no, match_no, text, repl, confidence, start FROM p UNION ALL SELECT doc_id, -1, 'word', -1, k, token, corrected, confidence, start::BIGINT FROM word),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lint, rule_no, match_no) AS ord FROM q WHERE text <> repl)"""


@query(_ERRORS + f' SELECT doc_id, ord, error_type, line + 1 AS line_num, "column" + 1 AS "column", text FROM {_placed("SELECT * FROM x WHERE ord <= 10")}')
def lint_top10(spark, sf_dir):
    return lint.lint_markdown(_docs(spark, sf_dir)).select("doc_id", "ord", "error_type", "line_num", "column", "text")


@query(_ERRORS + " SELECT doc_id, error_type, count(*) AS n FROM x GROUP BY doc_id, error_type")
def lint_by_type(spark, sf_dir):
    return lint.errors_by_type(lint.lint_markdown(_docs(spark, sf_dir), most=None)).select("doc_id", "error_type", "n")


_EXCEPTED = _lit("(?i)" + "|".join(f"(?:{p})" for p in rules.SPLIT_EXCEPTIONS).replace(r"\w", r"[\p{L}\p{N}_]"))
_ADVANCED = _positions_sql(lint.ADVANCED) + rf""",
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lint, rule_no, match_no) AS ord FROM p WHERE text <> repl AND confidence >= 0.7
  AND NOT (lint = 0 AND regexp_matches(text, {_EXCEPTED})) AND NOT (lint = 0 AND rule_no = {len(rules.SPLIT_WORD_RULES)} AND (regexp_matches(text, '\d')
    OR regexp_matches(text, '^[A-Z][a-z]+\s+[A-Z][a-z]+') OR regexp_matches(lower(text), ' ({"|".join(rules.NOT_SPLIT_BEFORE)})$') OR regexp_matches(text, '\s\p{{Lu}}'))))"""


@query(_ADVANCED + f' SELECT doc_id, ord, error_type, line + 1 AS line_num, "column" + 1 AS "column", text, repl AS suggestion, confidence::DOUBLE AS confidence, start FROM {_placed("SELECT * FROM x WHERE ord <= 20")}')
def lint_advanced(spark, sf_dir):
    return lint.lint_text(_docs(spark, sf_dir)).drop("sec_no")


@query(_ERRORS + f""", told AS (SELECT *, string_split(whole, chr(10))[line + 1] AS context FROM {_placed("SELECT * FROM x WHERE ord <= 10")}),
kinds AS (SELECT doc_id, error_type, count(*) AS n, min(ord) AS first FROM told GROUP BY doc_id, error_type),
heads AS (SELECT doc_id, string_agg('- ' || n || ' ' || error_type || ' issues', chr(10) ORDER BY first) AS types, sum(n)::BIGINT AS n FROM kinds GROUP BY doc_id),
bodies AS (SELECT doc_id, string_agg(ord || '. [' || upper(error_type) || '] Line ' || (line + 1) || ', Col ' || ("column" + 1) || ': ' || chr(39) || text || chr(39) || ' → ' || chr(39) || repl || chr(39) || ' (' || printf('%.2f', confidence) || ')' ||
    CASE WHEN context = '' THEN '' WHEN contains(context, text) THEN chr(10) || '   ' || left(context, strpos(context, text) - 1) || '>>>' || text || '<<<' || substring(context, strpos(context, text) + length(text)) || chr(10)
    ELSE chr(10) || '   ' || context || chr(10) END, chr(10) ORDER BY ord) AS body FROM told GROUP BY doc_id)
SELECT doc_id, 'Found ' || n || ' potential errors:' || chr(10) || chr(10) || types || chr(10) || chr(10) || body AS report FROM heads JOIN bodies USING (doc_id)""")
def lint_reports(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return lint.report(lint.with_context(lint.lint_markdown(docs), docs))


@query()
def fixed_text(spark, sf_dir):
    return lint.fix_text(_docs(spark, sf_dir))


# --- lexicon ----------------------------------------------------------------------------
@query(f"""SELECT doc_id, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({TOKENS}) WHERE token NOT IN (SELECT word FROM {LEXICON})) WHERE rn <= 10""")
def unknown_words(spark, sf_dir):
    from pyspark.sql import Window as W

    odd = correct.unknown(correct.tokens_of(_docs(spark, sf_dir)), correct.lexicon(spark))
    return odd.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).filter("rn <= 10").select("doc_id", "pos", "token")


@query(f"""SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE token IN (SELECT word FROM {LEXICON})) AS known FROM ({TOKENS}) GROUP BY doc_id""")
def known_word_ratio(spark, sf_dir):
    return correct.known_ratio(correct.tokens_of(_docs(spark, sf_dir)), correct.lexicon(spark))


@query(f"""SELECT token, min(word) AS suggestion FROM (SELECT DISTINCT token FROM ({TOKENS}) WHERE length(token) > 3) JOIN {LEXICON}
ON left(token, 2) = left(word, 2) AND abs(length(word) - length(token)) <= 2 GROUP BY token""")
def simple_suggestions(spark, sf_dir):
    return correct.suggestions(correct.tokens_of(_docs(spark, sf_dir)), correct.lexicon(spark))


@query(rf"""WITH RECURSIVE tok AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS token FROM documents) WHERE length(token) >= 3),
{_corrections_sql("tok")} SELECT token, corrected, round(confidence, 9) AS confidence FROM corrections""")
def word_corrections(spark, sf_dir):
    """Every distinct word of the documents."""
    found = correct.corrections(correct.tokens_of(_docs(spark, sf_dir), tokens=tx.word_tokens), correct.corrector_lexicon(spark))
    return found.withColumn("confidence", F.round("confidence", 9))


@query()
def corrected_text(spark, sf_dir):
    """Hyphens, OCR repairs and words; tested against the steps in plain Python."""
    return correct.correct_text(_docs(spark, sf_dir), correct.corrector_lexicon(spark), hyphens=[*rules.COMMON_WORDS, *rules.GAME_TERMS])


@query(f"""WITH tok AS ({TOKENS.replace("FROM documents", "FROM documents WHERE length(text) >= 10")}),
odd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM tok WHERE token NOT IN (SELECT word FROM {LEXICON})),
sug AS (SELECT token, min(word) AS suggestion FROM (SELECT DISTINCT token FROM odd WHERE rn <= 10 AND length(token) > 3) JOIN {LEXICON} ON left(token, 2) = left(word, 2) AND abs(length(word) - length(token)) <= 2 GROUP BY token),
l AS (SELECT doc_id, list(token || '>' || suggestion ORDER BY rn) AS issues FROM odd JOIN sug USING (token) WHERE rn <= 10 GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS total_words FROM tok GROUP BY doc_id), o AS (SELECT doc_id, count(*) AS unknown_words FROM odd GROUP BY doc_id)
SELECT doc_id, coalesce(total_words, 0) < 3 OR l.issues IS NULL AS valid, CASE WHEN total_words >= 3 THEN coalesce(l.issues, []) ELSE [] END AS issues, CASE WHEN total_words >= 3 THEN total_words END AS total_words,
  CASE WHEN total_words >= 3 THEN coalesce(unknown_words, 0) END AS unknown_words FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN l USING (doc_id)""")
def text_checks(spark, sf_dir):
    found = correct.check_text(_docs(spark, sf_dir), correct.lexicon(spark))
    return found.withColumn("issues", F.transform("issues", lambda x: F.concat(x["word"], F.lit(">"), x["suggestion"])))


@query()
def joined_hyphens(spark, sf_dir):
    run = correct.join_hyphens([*rules.COMMON_WORDS, *rules.GAME_TERMS])
    return _docs(spark, sf_dir).select("doc_id", run("text").alias("text"))


# --- samples and paragraphs -------------------------------------------------------------
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM ({CLEAN_LINES}) WHERE text <> ''"


@query(f"SELECT doc_id, line_no, text FROM ({_NUMBERED}) WHERE list_contains(list_transform(generate_series(0, least(n, 50) - 1), lambda i: i * n // least(n, 50)), rn)")
def systematic_sample(spark, sf_dir):
    return segment.systematic_sample(segment.split_lines(_docs(spark, sf_dir), split_long=False))


@query(f"SELECT doc_id, line_no, text FROM ({_NUMBERED}) WHERE rn = 0 OR rn = n - 1 OR (n > 10 AND rn = n // 2)")
def edge_sample(spark, sf_dir):
    return segment.edge_sample(segment.split_lines(_docs(spark, sf_dir), split_long=False))


_JOINS = "|".join(rules.CONJUNCTIONS)
#: Places where a joining word ends: \b in Java's Unicode sense, on masked text.
_GOES_ON = rf"NOT regexp_matches(p, '[.!?]$') OR regexp_matches(t, '^[a-z]') OR regexp_matches(regexp_replace(t, '[^\x00-\x7F]', '_', 'g'), '(?i)^({_JOINS})\b') OR regexp_matches(p, '[,;:]$')"


@query(f"""SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY para) AS text FROM (
  SELECT doc_id, para, regexp_replace(string_agg(t, ' ' ORDER BY line_no), ' +', ' ', 'g') AS t FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS para FROM (
      SELECT *, CASE WHEN p IS NULL OR NOT ({_GOES_ON}) THEN 1 ELSE 0 END AS new FROM (
        SELECT doc_id, line_no, t, lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (SELECT doc_id, line_no, {TRIM.format('raw')} AS t FROM ({LINES})) WHERE t <> '')))
  GROUP BY doc_id, para) GROUP BY doc_id""")
def paragraphs(spark, sf_dir):
    return segment.paragraphs(segment.raw_lines(_docs(spark, sf_dir)), clean=False)


_HANGS = " OR ".join(f"ends_with(rtrim(p, ' '), {_lit(w)})" for w in rules.HANGING_WORDS)


@query(rf"""WITH RECURSIVE {SPLIT_LINES}, b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM split_lines),
c AS (SELECT *, coalesce(regexp_matches(regexp_replace(text, '[^\x00-\x7F•]', '_', 'g'), '^[a-z]|^({_JOINS})\b|^\s*[,;]\s*|^\s*[-•]\s*') OR {_HANGS}
  OR (NOT regexp_matches(p, '[.!?:;,]\s*$') AND NOT regexp_matches(text, '^\p{{Lu}}')), false) AS goes FROM b),
r AS (SELECT *, sum((p IS NULL OR NOT goes)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c),
s AS (SELECT *, row_number() OVER w AS k, lead(text) OVER w AS after FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no))
SELECT doc_id, run - 1 AS line_no, string_agg(CASE WHEN k = 1 OR ends_with(p, '-') OR regexp_matches(text, '^[,.;:?!]') THEN '' ELSE ' ' END ||
  CASE WHEN after IS NOT NULL AND ends_with(text, '-') THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY line_no) AS text FROM s GROUP BY doc_id, run""")
def merged_lines(spark, sf_dir):
    return segment.merge_lines(segment.split_lines(_docs(spark, sf_dir)))


_CUT = """CASE WHEN strpos(reverse(left(rest, 2000)), chr(10) || chr(10)) > 0 THEN 2001 - strpos(reverse(left(rest, 2000)), chr(10) || chr(10))
  WHEN strpos(reverse(left(rest, 2000)), ' .') > 0 THEN 2001 - strpos(reverse(left(rest, 2000)), ' .') ELSE 2000 END"""


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, 0 AS chunk_no, text AS rest FROM documents UNION ALL SELECT doc_id, chunk_no + 1, substring(rest, a + 1) FROM (SELECT *, {_CUT} AS a FROM r) WHERE length(rest) > 2000)
SELECT doc_id, chunk_no, CASE WHEN length(rest) > 2000 THEN {_CUT} ELSE length(rest) END AS n_chars FROM r WHERE rest <> ''""")
def text_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(segment.chunks("text", 2000)).alias("chunk_no", "text")).select("doc_id", "chunk_no", F.length("text").alias("n_chars"))


# --- chapters, with headings put in -----------------------------------------------------
def _with_headings(spark, sf_dir):
    """Every tenth line becomes a spaced chapter heading, every fifth after it a subheading."""
    rows = segment.raw_lines(_docs(spark, sf_dir))
    head = F.concat(F.lit("C h a p t e r "), (F.floor(F.col("line_no") / 10) + 1).cast("string"), F.lit(" : R a c e s"))
    return rows.withColumn("text", F.when(F.col("line_no") % 10 == 0, head).when(F.col("line_no") % 10 == 5, F.lit("H i l l D w a r f")).otherwise(tx.clean_line("text")))


_HEADED = f"""SELECT doc_id, line_no, CASE WHEN line_no % 10 = 0 THEN 'Chapter ' || (line_no // 10 + 1) || ' : Races' WHEN line_no % 10 = 5 THEN 'H i l l D w a r f' ELSE text END AS text, line_no % 10 = 0 AS headed FROM ({CLEAN_LINES})"""
_SPACED = r"""regexp_matches(text, '^[A-Z](\s+[a-z])+$') OR regexp_matches(text, '^([A-Z](\s+[a-z])+\s+)+[A-Z](\s+[a-z])+$')"""
_MARKED = rf"""SELECT *, headed OR (({_SPACED}) AND regexp_matches(replace(text, ' ', ''), '(?i)^({"|".join(rules.CHAPTER_TITLES)})$')) AS is_chapter FROM ({_HEADED})"""
_SEGMENTS = f"""SELECT *, sum(is_sub::INT) OVER (PARTITION BY doc_id, chapter_seq ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sub_seq FROM (
  SELECT *, sum(is_chapter::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chapter_seq, NOT is_chapter AND ({_SPACED}) AND length(replace(text, ' ', '')) <= 50 AS is_sub FROM ({_MARKED}))"""


@query(f"SELECT doc_id, chapter_seq, sub_seq, count(*) AS n_lines FROM ({_SEGMENTS}) GROUP BY doc_id, chapter_seq, sub_seq")
def segment_sizes(spark, sf_dir):
    return segment.chapter_lines(_with_headings(spark, sf_dir)).groupBy("doc_id", "chapter_seq", "sub_seq").agg(F.count("*").alias("n_lines"))


@query(rf"""SELECT doc_id, line_no, regexp_extract(text, '^Chapter\s+(\d+)', 1)::INT AS number, regexp_extract(text, '^Chapter\s+\d+\s*:?\s*(.+)$', 1) AS title FROM ({_HEADED}) WHERE headed""")
def chapter_headers(spark, sf_dir):
    rows = segment.chapter_lines(_with_headings(spark, sf_dir)).filter("is_chapter and line_no % 10 = 0")
    return rows.select("doc_id", "line_no", segment.chapter_header("flat").alias("h")).select("doc_id", "line_no", "h.number", "h.title")


@query(f"""SELECT doc_id, count(*) AS total_chapters, avg(n) AS avg_chapter_length FROM (SELECT doc_id, chapter_seq, count(*) FILTER (WHERE NOT is_chapter AND NOT is_sub) AS n FROM ({_SEGMENTS}) GROUP BY doc_id, chapter_seq) GROUP BY doc_id""")
def chapter_stats(spark, sf_dir):
    return segment.chapter_stats(segment.chapters(_with_headings(spark, sf_dir)))


@query()
def chapter_sections(spark, sf_dir):
    return structure.sections_of_chapters(segment.chapters(_with_headings(spark, sf_dir)))


@query(f"""WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 > 0 THEN left(raw, 1) ELSE raw END AS text FROM ({LINES})),
g AS (SELECT *, sum((NOT regexp_matches(text, '^[a-zA-Z]$'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1) // 5 AS k FROM g WHERE regexp_matches(text, '^[a-zA-Z]$'))
SELECT doc_id, min(line_no) AS line_no, string_agg(text, '' ORDER BY line_no) AS text, count(*) AS consumed FROM k GROUP BY doc_id, g, k""")
def vertical_text(spark, sf_dir):
    rows = segment.raw_lines(_docs(spark, sf_dir))
    return segment.vertical_text(rows.withColumn("text", F.when(F.col("line_no") % 3 > 0, F.substring("text", 1, 1)).otherwise(F.col("text"))))


# --- Markdown ---------------------------------------------------------------------------
def _fenced(spark, sf_dir):
    """conv_id, line_no, text: turns as lines, with a fence line before every third turn."""
    rows = _docs(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.col("turn").alias("line_no"), F.when(F.col("turn") % 3 == 1, F.lit(" ```")).otherwise(F.concat("role", F.lit(": "), F.length("text").cast("string"))).alias("text"))


@query("""SELECT conv_id, sec_no, CASE WHEN sec_no % 2 = 1 THEN 'code' ELSE 'text' END AS type, min(line_no) AS start_line,
  CASE WHEN sec_no % 2 = 1 AND max(seen) > sec_no THEN max(line_no) ELSE max(line_no) + 1 END AS end_line, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM (SELECT *, CASE WHEN fence AND seen % 2 = 0 THEN seen - 1 ELSE seen END AS sec_no FROM (
  SELECT *, sum(fence::INT) OVER (PARTITION BY conv_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seen FROM (
    SELECT conv_id, turn AS line_no, turn % 3 = 1 AS fence, CASE WHEN turn % 3 = 1 THEN ' ```' ELSE role || ': ' || length(text) END AS text FROM conversations)))
GROUP BY conv_id, sec_no""")
def code_sections(spark, sf_dir):
    return segment.md_sections(_fenced(spark, sf_dir), "conv_id", ignore_code=False)


def _conversation_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    part = F.concat(F.lit("## "), "role", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))).alias("l"))
    return out.select("conv_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


@query("""SELECT conv_id, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 ELSE 0 END AS chunk_no, '## ' || role || chr(10) || replace(text, chr(10), ' ') AS text
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def md_chapters(spark, sf_dir):
    return segment.md_chapters(_conversation_documents(spark, sf_dir), "conv_id")


# --- tables and contents ----------------------------------------------------------------
@query(rf"""SELECT doc_id, n_lines, n_level, n_hit_die, n_class_name, n_lines >= 5 AND ((n_class_name >= 1.25 AND n_hit_die >= 1.25 AND n_ability >= 1.25) OR (n_level >= 1.25 AND n_modifier >= 1.25 AND n_feature >= 1.25)) AS is_table,
  CASE WHEN n_class_name >= 3 AND n_hit_die >= 3 AND n_ability >= 3 THEN 'class_table' WHEN n_level >= 3 AND n_modifier >= 3 AND n_feature >= 3 THEN 'level_progression' END AS table_type
FROM (SELECT doc_id, count(*) AS n_lines, {", ".join(f"sum(regexp_matches(t, {_lit('(?i)' + p)})::INT) AS n_{k}" for k, p in rules.COLUMN_CLASSES.items())}
  FROM (SELECT doc_id, CASE WHEN line_no % 4 = 1 THEN 'd' || (line_no % 7 + 4) WHEN line_no % 8 = 2 THEN 'Wisdom' WHEN line_no % 8 = 6 THEN '+2' ELSE text END AS t FROM ({CLEAN_LINES})) GROUP BY doc_id)""")
def table_detect(spark, sf_dir):
    rows, n = segment.raw_lines(_docs(spark, sf_dir)), F.col("line_no")
    t = F.when(n % 4 == 1, F.concat(F.lit("d"), (n % 7 + 4).cast("string"))).when(n % 8 == 2, F.lit("Wisdom")).when(n % 8 == 6, F.lit("+2")).otherwise(tx.clean_line("text"))
    return tables.detect(rows.withColumn("text", t), "doc_id").select("doc_id", "n_lines", "n_level", "n_hit_die", "n_class_name", "is_table", "table_type")


@query("""SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def markdown_table(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return tables.table_of_rows(nation, ["n_nationkey", "n_name"], "n_regionkey", order=["n_nationkey"])


@query()
def parsed_tables(spark, sf_dir):
    """Lines of each document as a level table: a level, its bonus, a feature, and text."""
    rows, n = segment.raw_lines(_docs(spark, sf_dir)), F.col("line_no")
    t = F.when(n % 4 == 0, F.concat((F.floor(n / 4) + 1).cast("string"), F.lit("th"))).when(n % 4 == 1, F.lit("+2")).when(n % 4 == 2, F.lit("Rage")).otherwise(tx.clean_line("text"))
    lines = rows.withColumn("text", t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l")).select("doc_id", F.transform("l", lambda x: x["text"]).alias("lines"))
    return lines.select("doc_id", tables.parse("lines", F.lit("level_progression")).alias("t")).select("doc_id", F.size("t.rows").alias("n_rows"), tables.markdown_table(F.col("t.columns"), F.col("t.rows")).alias("markdown"))


def _contents_sql():
    return f"""WITH c AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 0 THEN 'Chapter ' || (line_no // 6 + 1) || ': Part ' || line_no WHEN line_no % 18 = 5 THEN 'Appendix ' || chr((65 + line_no // 18 % 26)::INT) || ': Rest ' || line_no
  ELSE 'Head of ' || length(text) || '.' || (line_no + 1) END AS t FROM ({CLEAN_LINES})),
k AS (SELECT *, CASE WHEN line_no % 6 = 0 THEN 'chapter' WHEN line_no % 18 = 5 THEN 'appendix' END AS kind FROM c),
o AS (SELECT *, sum((kind IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ord FROM k)
SELECT doc_id, ord, max(kind) AS type, max(CASE WHEN kind = 'chapter' THEN line_no // 6 + 1 END) AS number, max(CASE WHEN kind = 'appendix' THEN chr((65 + line_no // 18 % 26)::INT) END) AS letter,
  max(CASE WHEN kind = 'chapter' THEN 'Part' WHEN kind = 'appendix' THEN 'Rest' END) AS title, max(CASE WHEN kind IS NOT NULL THEN line_no END) AS page,
  CASE WHEN max(kind) = 'chapter' THEN count(*) - 1 ELSE 0 END AS n_sections FROM o WHERE ord > 0 GROUP BY doc_id, ord"""


@query(_contents_sql())
def toc_entries(spark, sf_dir):
    rows, n = segment.raw_lines(_docs(spark, sf_dir)), F.col("line_no")
    text = lambda x: x.cast("string")
    t = (
        F.when(n % 6 == 0, F.concat(F.lit("Chapter "), text(F.floor(n / 6) + 1), F.lit(": Part "), text(n)))
        .when(n % 18 == 5, F.concat(F.lit("Appendix "), F.char(F.floor(n / 18) % 26 + 65), F.lit(": Rest "), text(n)))
        .otherwise(F.concat(F.lit("Head of "), text(F.length(tx.clean_line("text"))), F.lit("."), text(n + 1)))
    )
    found = segment.toc(rows.withColumn("text", t))
    return found.select("doc_id", "ord", "type", "number", "letter", "title", "page", F.size("sections").alias("n_sections"))


def _book(spark, sf_dir):
    """Each document as a book: contents, two chapters that hold its text, an appendix."""
    body = tx.clean_extracted_text("text")
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("A Book\n\nContents\nChapter 1: Races 3\nDwarf.4\nAppendix A: Rest 9\n\nChapter 1 : Races\nHill Dwarf\n"), body, F.lit("\nChapter 2 : Classes\n"), F.substring(body, 1, 200), F.lit("\nAppendix A: Conditions\nBlinded\nNo sight.\n")).alias("text"))


@query()
def structured_documents(spark, sf_dir):
    made = structure.structured(_book(spark, sf_dir), clean=False)
    return made.select("doc_id", "metadata.title", F.size("table_of_contents").alias("n_toc"), F.size("chapters").alias("n_chapters"), F.size("appendices").alias("n_appendices"), F.to_json("chapters").alias("chapters"))


@query()
def render_markdown(spark, sf_dir):
    return render.markdown(structure.structured(_book(spark, sf_dir), clean=False), extracted_on=F.lit("2020-01-01 00:00:00"))


@query()
def processed_markdown(spark, sf_dir):
    return pipeline.process(_docs(spark, sf_dir), "markdown")


@query("""SELECT conv_id, turn, list_filter([CASE WHEN turn % 3 = 0 THEN 'Missing required field: output_type' END, CASE WHEN turn % 2 = 1 THEN 'Field ''content'' must be either a string or a dictionary' END], lambda x: x IS NOT NULL) AS errors FROM conversations""")
def schema_check(spark, sf_dir):
    """Envelopes with a missing field or a list for content."""
    rows = _docs(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    kind = F.when(F.col("turn") % 3 != 0, F.lit("raw"))
    whole = F.struct(F.lit("a.txt").alias("filename"), F.lit("2020-01-01").alias("extraction_date"), kind.alias("output_type"), F.col("text").alias("content"))
    listed = F.struct(F.lit("a.txt").alias("filename"), F.lit("2020-01-01").alias("extraction_date"), kind.alias("output_type"), F.array("text").alias("content"))
    return rows.select("conv_id", "turn", quality.json_envelope_errors(F.when(F.col("turn") % 2 == 1, F.to_json(listed)).otherwise(F.to_json(whole))).alias("errors"))
