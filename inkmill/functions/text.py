"""Text functions as Column expressions: normalisers, predicates, tokenizers.

Python's \\w, \\s, \\d and \\b know Unicode, so patterns carry (?U). Null stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions import rules

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pattern(p: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """p for Java's regular expressions, with Unicode classes."""
    return ("(?iuU)" if ignore_case else "(?U)") + ("(?m)" if multiline else "") + p


def sub(x: C, p: str, by: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    """re.sub: groups are \\1, \\2 in `by`."""
    java = by.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2")
    return F.regexp_replace(_c(x), F.lit(pattern(p, ignore_case, multiline)), F.lit(java))


def subs(x: C, table: Iterable[tuple[str, str]], **how) -> Column:
    for p, by in table:
        x = sub(x, p, by, **how)
    return _c(x)


def has(x: C, p: str, ignore_case: bool = False) -> Column:
    return _c(x).rlike(pattern(p, ignore_case))


def all_matches(x: C, p: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(pattern(p, ignore_case)), F.lit(group))


def ustrip(x: C) -> Column:
    """str.strip(): white space of any script at both ends."""
    return sub(x, r"^\s+|\s+\z", "")


def lines(x: C) -> Column:
    return F.split(_c(x), "\n", -1)


def words(x: C) -> Column:
    """str.split(): runs of anything but white space."""
    return all_matches(x, r"\S+")


# --- line and text normalisers ----------------------------------------------------------
def clean_extracted_text(x: C) -> Column:
    """Extraction clean-up: line ends, blank lines, bullets and sentences on lines of their
    own, every line stripped, empty lines dropped."""
    y = F.replace(_c(x), F.lit("\\n"), F.lit("\n"))
    y = subs(y, [(r"\r\n|\r", "\n"), (r"\n{3,}", "\n\n"), (r" {2,}", " ")])
    y = sub(F.replace(y, F.lit("•"), F.lit("\n•")), r"([.!?])\s*([A-Z])", "\\1\n\\2")
    return F.array_join(F.filter(F.transform(lines(y), ustrip), lambda s: s != ""), "\n")


def clean_line(x: C) -> Column:
    return sub(ustrip(x), r"\s+", " ")


def split_long_line(x: C, most: int = 2000) -> Column:
    """array: the line, or if longer than `most` its sentences packed greedily; a longer
    sentence stays whole. Each sentence counts with one separator."""
    marked = sub(x, r"([.!?])\s+", "\\1\u0000")
    sentences = F.split(marked, "\u0000", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, y: Column) -> Column:
        # A sentence that opens an entry after another counts without its separator.
        n, fits = F.length(y), s["n"] + F.length(y) + 1 <= most
        joined = F.when(s["now"].isNull(), y).otherwise(F.concat(s["now"], F.lit(" "), y))
        return F.when(fits, F.struct(s["done"].alias("done"), joined.alias("now"), (s["n"] + n + 1).alias("n"))).otherwise(
            F.struct(F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])).alias("done"), y.alias("now"), n.alias("n"))
        )

    packed = F.aggregate(sentences, start, step, lambda s: F.array_append(s["done"], s["now"]))
    return F.when(F.length(_c(x)) <= most, F.array(_c(x))).otherwise(packed)


def collapse_spaced_letters(x: C) -> Column:
    """Maximal runs of single letters become words: "H i l l  D w a r f" -> "HillDwarf"."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run"))

    def flush(s: Column) -> Column:
        return F.when(s["run"] != "", F.array_append(s["done"], s["run"])).otherwise(s["done"])

    def step(s: Column, w: Column) -> Column:
        one = has(w, r"^\p{L}\z")
        return F.when(one, F.struct(s["done"].alias("done"), F.concat(s["run"], w).alias("run"))).otherwise(
            F.struct(F.array_append(flush(s), w).alias("done"), F.lit("").alias("run"))
        )

    fold = F.array_join(F.aggregate(words(x), start, step, flush), " ")
    # Few lines have a single letter at all; the others are only put in order.
    return F.when(has(x, r"(?:^|\s)\p{L}(?:\s|\z)"), fold).otherwise(ustrip(sub(x, r"\s+", " ")))


def _fuse(x: Column, p: str, least: int) -> Column:
    """Every match of p of at least `least` characters, with its white space removed wherever it occurs."""
    found = F.filter(F.regexp_extract_all(x, F.lit(pattern(p)), F.lit(0)), lambda m: F.length(m) >= least)
    return F.aggregate(found, x, lambda y, m: F.replace(y, m, F.regexp_replace(m, F.lit(r"(?U)\s+"), F.lit(""))))


def clean_content_line(x: C, join_lower: bool = True) -> Column:
    """Strips, fuses spaced letters, normalises two terms and, unless join_lower is off,
    joins every two words that meet in lower-case letters."""
    y = _fuse(ustrip(x), r"\b(?:[A-Za-z](?:\s+[A-Za-z]){2,})\b", 6)
    y = subs(y, [(r"D\s*&\s*D", "D&D"), (r"Dungeons\s*&\s*Dragons", "Dungeons & Dragons")])
    y = sub(y, r"([a-z])\s([a-z])", r"\1\2") if join_lower else y
    return ustrip(sub(y, r"\s{2,}", " "))


_SPLIT_WORDS = r"(?:[A-Z]\s+[a-z]+)|(?:[A-Z]\s+){2,}[A-Z]|[A-Z](?:\s*\n\s*[A-Z])+[A-Z]"

_SPLIT_WORDS_APART = r"(?:[A-Z]\s+[a-z]+)|(?:[A-Z]\s+){2,}[A-Z]|[A-Z](?:\s*[A-Z])+[A-Z]?"


def _glue(y: Column, p: str, least: int = 0) -> Column:
    """y with every match of p of at least `least` characters without its white space."""
    found, rest = F.regexp_extract_all(y, F.lit(pattern(p)), F.lit(0)), F.split(y, pattern(p), -1)
    glued = F.transform(found, lambda m: F.when(F.length(m) >= least, F.regexp_replace(m, F.lit(r"(?U)\s+"), F.lit(""))).otherwise(m))
    return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(glued, i), F.lit("")))), "")


def _join_letters(y: Column, p: str) -> Column:
    """y with the words of every match of p one space apart, but runs of single letters joined."""
    found, rest = F.regexp_extract_all(y, F.lit(pattern(p)), F.lit(0)), F.split(y, pattern(p), -1)
    apart = F.transform(found, lambda m: F.regexp_replace(m, F.lit(r"(?U)\s+"), F.lit(" ")))
    joined = F.transform(apart, lambda m: F.regexp_replace(m, F.lit(r"(?<=(?<!\S)[A-Za-z]) (?=[A-Za-z](?!\S))"), F.lit("")))
    return F.when(F.size(found) == 0, y).otherwise(
        F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(joined, i), F.lit("")))), "")
    )


def _until_stable(y: Column, once, most: Column) -> Column:
    """once(y), again until nothing changes; `most` is a bound that the text itself gives on
    the passes that can change it. Nothing is evaluated after the last change."""
    start = F.struct(y.alias("text"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = F.transform(F.array(once(s["text"])), lambda z: F.struct(z.alias("text"), (z == s["text"]).alias("done")))
        return F.when(F.coalesce(s["done"], F.lit(True)), s).otherwise(F.element_at(new, 1))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["text"])


def _joined_until_stable(y: Column, p: str) -> Column:
    """Every pass that joins takes away white space after a capital, and one that only makes
    white space one space is followed by one that changes nothing."""
    after_capital = F.coalesce(F.regexp_count(y, F.lit(r"(?U)[A-Z]\s")), F.lit(0))
    return _until_stable(y, lambda z: _join_letters(z, p), 2 * after_capital + 2)


def join_split_capitals(x: C) -> Column:
    """Letters on two lines become words apart; runs of single letters that start with a
    capital are joined until nothing changes. A letter before a longer word stays apart."""
    return _joined_until_stable(sub(x, r"([A-Za-z])\s*\n\s*([A-Za-z])", r"\1 \2"), _SPLIT_WORDS)


def join_split_words(x: C) -> Column:
    """As join_split_capitals(), but letters on two lines are joined without a space."""
    return _joined_until_stable(sub(x, r"([A-Za-z])\s*\n\s*([A-Za-z])", r"\1\2"), _SPLIT_WORDS_APART)


def _spaced_small_words(x: Column, bounded: bool) -> Column:
    b = r"\b" if bounded else ""
    return subs(x, [(f"{b}o f{b}", "of"), (f"{b}a n d{b}", "and"), (f"{b}t h e{b}", "the")])


def clean_text(x: C, bounded: bool = True) -> Column:
    """Structure clean-up: line ends trimmed, spaced small words joined (at word bounds unless
    bounded is off), capitals joined, hyphens at line ends removed, dot leaders to bullets."""
    y = join_split_capitals(_spaced_small_words(sub(x, r"\s*\n\s*", "\n"), bounded))
    return ustrip(subs(y, [(r"\n{3,}", "\n\n"), (r"(\w+)-\n(\w+)", r"\1\2"), (r"\.{3,}", " • ")]))


def preprocess_text(x: C, bounded: bool = True) -> Column:
    y = subs(join_split_words(x), [(r"\s*\n\s*", "\n"), (r"\n{3,}", "\n\n")])
    return ustrip(sub(_spaced_small_words(y, bounded), r"\.{3,}", " • "))


def fix_spaced_words(x: C) -> Column:
    return _glue(_c(x), r"\b(?:[A-Za-z])\s+(?:[A-Za-z])\s+(?:[A-Za-z])(?:\s+[A-Za-z])*\b", 5)


def fix_common_terms(x: C) -> Column:
    return sub(sub(x, r"D\s*&\s*D", "D&D"), r"Dun\s*g?e?o?n?s?\s*&\s*Dra\s*g?o?n?s?", "Dungeons & Dragons", ignore_case=True)


def fix_run_together(x: C, lexicon: Iterable[str] = rules.RUN_TOGETHER_WORDS) -> Column:
    """A space before and after each lexicon word of three letters or more that touches a
    letter; longer words first, equal ones in order of the alphabet."""
    y = _c(x)
    for w in sorted({w for w in lexicon if len(w) >= 3}, key=lambda w: (-len(w), w)):
        y = F.regexp_replace(F.regexp_replace(y, F.lit(f"(?<=[a-zA-Z])({w})"), F.lit(" $1")), F.lit(f"({w})(?=[a-zA-Z])"), F.lit("$1 "))
    return y


def run_together_fixer(lexicon: Iterable[str] = rules.RUN_TOGETHER_WORDS):
    """fix_run_together() as a pandas UDF, for whole columns: its rules never look beyond a run
    of letters, so each distinct run is mended once instead of in 180 passes over the text."""
    order = sorted({w for w in lexicon if len(w) >= 3}, key=lambda w: (-len(w), w))

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        pairs = [(w, re.compile(f"(?<=[a-zA-Z])({w})"), re.compile(f"({w})(?=[a-zA-Z])")) for w in order]
        known: dict[str, str] = {}

        def mend(m: re.Match) -> str:
            word = m[0]
            if word not in known:
                if len(known) > 300_000:
                    known.clear()
                new = word
                for w, after, before in pairs:
                    if w in new:
                        new = before.sub(r"\1 ", after.sub(r" \1", new))
                known[word] = new
            return known[word]

        letters = re.compile("[A-Za-z]{4,}")
        return texts.map(lambda t: None if t is None else letters.sub(mend, t))

    return run


def fix_common_spacing(x: C) -> Column:
    return subs(x, rules.COMMON_SPACING)


def clean_paragraph(x: C, level: str = "light", run_together=fix_run_together) -> Column:
    """level none: as it is; basic: spaced words and terms; light, advanced: run-together
    words and common spacing too. Fewer than five characters: as they are. On whole columns
    pass run_together_fixer(), which is faster; inside array functions only expressions work."""
    if level == "none":
        return _c(x)
    y = fix_common_terms(fix_spaced_words(x))
    if level in ("light", "advanced"):
        y = fix_common_spacing(run_together(y))
    return F.when(F.length(_c(x)) < 5, _c(x)).otherwise(y)


def clean_content_text(x: C) -> Column:
    """Rendering clean-up: spaced letters fused in threes until none are left, terms, and
    sixteen words split from what follows them."""
    p = pattern(r"\b([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])")

    def fuse(y: Column) -> Column:
        one = F.transform(F.array(F.regexp_extract(y, p, 0)), lambda m: F.when(m == "", y).otherwise(F.replace(y, m, F.regexp_replace(m, F.lit(r"(?U)\s+"), F.lit("")))))
        return F.element_at(one, 1)

    y = ustrip(x)
    # Every pass but the last takes two white-space characters or more away.
    y = _until_stable(y, fuse, F.when(y.rlike(p), F.length(y) / 2 + 1).otherwise(1).cast("int"))
    y = subs(y, [(r"D\s*&\s*D", "D&D"), (r"Dungeons\s*&\s*Dragons", "Dungeons & Dragons")])
    y = subs(y, [(rf"\b{w}([a-z])", rf"{w} \1") for w in rules.SPLITTABLE_WORDS])
    return F.when(F.length(_c(x)) < 3, _c(x)).otherwise(ustrip(sub(y, r"\s{2,}", " ")))


# --- titles and names -------------------------------------------------------------------
def normalize_title(x: C, literal: bool = False) -> Column:
    """A heading: page numbers and dots dropped, spaced letters fused (in pairs only if
    literal), camel case split, hyphens to spaces, every word capitalised."""
    y = subs(x, [(r"\.{2,}.*?\d+$", ""), (r"\.{3,}", "")])
    if literal:
        start = F.array().cast("array<string>")
        single = lambda w: has(w, r"^\p{L}\z")

        def step(a: Column, w: Column) -> Column:
            fused = F.array_append(F.slice(a, 1, F.size(a) - 1), F.concat(F.element_at(a, -1), w))
            return F.when(single(w) & (F.size(a) > 0) & (F.length(F.try_element_at(a, F.lit(-1))) == 1), fused).otherwise(F.array_append(a, w))

        fused = F.array_join(F.aggregate(words(y), start, step), " ")
    else:
        fused = collapse_spaced_letters(y)
    y = F.when(F.contains(y, F.lit(" ")), fused).otherwise(y)
    y = ustrip(subs(y, [(r"([a-z])([A-Z])", r"\1 \2"), (r"[\s\-]+", " ")]))
    y = F.initcap(F.replace(y, F.lit("D & D"), F.lit("D&D")))
    return F.when(F.coalesce(_c(x), F.lit("")) == "", F.lit("Untitled Section")).otherwise(y)


def title_case(x: C) -> Column:
    """str.title(): every run of letters has its first upper-cased, the rest lower-cased."""
    runs = all_matches(x, r"\p{L}+|\P{L}+")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def clean_filename(x: C) -> Column:
    """Stem without extension, "_" and "-" to spaces, in title case."""
    return title_case(F.translate(F.regexp_replace(_c(x), F.lit(r"(?<=.)\.[^./\\]*$"), F.lit("")), "_-", "  "))


def title_of_stem(x: C) -> Column:
    return title_case(F.translate(_c(x), "_", " "))


def anchor(x: C) -> Column:
    return sub(F.replace(F.lower(_c(x)), F.lit(" "), F.lit("-")), r"[^\w-]", "")


def page_number(x: C) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(_c(x), pattern(r"\s*(\d+)\s*$"), 1), F.lit("")), F.lit("9" * 18)).cast("int")


def escape_yaml(x: C) -> Column:
    return F.regexp_replace(_c(x), F.lit(r"([*&\[\]{}])"), F.lit(r"\\$1"))


# --- tokens -----------------------------------------------------------------------------
def collapse_space(x: C) -> Column:
    return ustrip(sub(x, r"\s+", " "))


def simple_tokens(x: C) -> Column:
    return words(sub(F.lower(_c(x)), r"[^\w\s]", " "))


def word_tokens(x: C) -> Column:
    return all_matches(x, r"\b(\w+)\b", 1)


def word_and_gap_tokens(x: C) -> Column:
    """Words (letters, digits, apostrophes) and what stands between, in order."""
    return all_matches(x, r"[\p{L}\p{N}']+|[^\p{L}\p{N}']+")


# --- predicates -------------------------------------------------------------------------
def has_spaced_text(x: C) -> Column:
    return has(x, rules.SPACED_TEXT[0]) | has(x, rules.SPACED_TEXT[1]) | has(x, rules.SPACED_TEXT[2])


def is_chapter_title(x: C) -> Column:
    titles = rf"^({'|'.join(rules.CHAPTER_TITLES)})\s*$"
    found = has(x, r"^Chapter\s+\d+\s*:?\s*\w", True) | has(x, r"^\d+\s*$", True) | has(x, titles, True) | has(x, rules.STEP_BY_STEP, True)
    return found & ~has(x, rules.TOC_TAILS[0]) & ~has(x, rules.TOC_TAILS[1])


def is_subchapter_title(x: C) -> Column:
    """Spaced text that, collapsed, has at most 50 characters and only capitalised words."""
    y = collapse_spaced_letters(x)
    return has_spaced_text(x) & (F.length(y) <= 50) & F.forall(words(y), lambda w: has(w, r"^\p{Lu}"))


def subchapter_title(x: C) -> Column:
    return F.array_join(F.regexp_extract_all(collapse_spaced_letters(x), F.lit("[A-Z][^A-Z ]*"), F.lit(0)), " ")


def looks_like_toc_entry(x: C) -> Column:
    return F.contains(_c(x), F.lit(".....")) | has(x, r"\s\d+$")


def is_appendix_heading(x: C) -> Column:
    y = F.lower(_c(x))
    return F.exists(F.array(*[F.lit(p) for p in rules.APPENDIX_PHRASES]), lambda p: F.contains(y, p))


def is_scanned(x: C, least: int = 100) -> Column:
    return F.length(ustrip(x)) < least


def is_sufficient(x: C, least: int = 100, markers: Iterable[str] = rules.SUFFICIENCY_MARKERS) -> Column:
    y = F.length(ustrip(x)) >= least
    for m in markers:
        y = y & ~F.contains(_c(x), F.lit(m))
    return y


def is_heading(x: C) -> Column:
    return has(x, r"^#{1,2}\s+")


def is_fence(x: C) -> Column:
    return F.startswith(ustrip(x), F.lit("```"))


def is_continuation(line: C, previous: C, ignore_case: bool = True) -> Column:
    """Whether a line goes on from the previous one. With ignore_case any first letter counts."""
    p = rf"^[a-z]|^({'|'.join(rules.CONJUNCTIONS)})\b|^\s*[,;]\s*|^\s*[-•]\s*"
    hanging = F.lit(False)
    for w in rules.HANGING_WORDS:
        hanging = hanging | F.endswith(sub(previous, r"\s+\z", ""), F.lit(w))
    goes_on = ~has(previous, r"[.!?:;,]\s*$") & ~has(line, r"^\p{Lu}")
    both = (F.coalesce(_c(line), F.lit("")) != "") & (F.coalesce(_c(previous), F.lit("")) != "")
    return both & (has(line, p, ignore_case) | hanging | goes_on)
