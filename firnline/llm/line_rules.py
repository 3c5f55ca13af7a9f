"""Line-first cleaning: judge every line, remove those that fail, reject documents that lose too much.

A line (text between \\n) with words fails if
  punctuation  no word of it ends a sentence, although it has LONG_LINE words or more; or more than
               half of its words are exclamations or questions
  navigation   it holds two or more lone separators (| » › • ·) that make up a tenth of its words
  symbols      words with two or more of # * $ % & | < > in a row make up a fifth of its words
  boilerplate  a phrase of BOILERPLATE occurs in it and it has fewer than LONG_LINE words
Lines without words are kept as they are. A document is rejected if its failing lines hold more
than half of its words, or by base rules on the whole text.

Everything is an expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.texts import SPACE, WORD, count_words, let, words

SYMBOLS = r"[#*$%&|<>]"
LONG_LINE = 20
MIN_WORDS = 50
#: Rejected if more than this share of the words lies in failing lines (in hundredths).
MOST_LOST = 50
#: Sentence marks (Latin; ideographic, full-width, Arabic, Urdu, Indic, Armenian, Ethiopic, Khmer, Myanmar, Tibetan).
LATIN_MARKS, OTHER_MARKS = ".!?", "…。｡．！？؟۔।॥։።፧፨។៕။།"
AFTER_MARK = r"[\"'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"
#: The second form says the same for Java, which then asks most letters for a range before it asks for each mark.
SENTENCE_END = rf"[{LATIN_MARKS}{OTHER_MARKS}]{AFTER_MARK}"
SENTENCE_END_JAVA = rf"[{LATIN_MARKS}[\u0500-\uffff&&[{OTHER_MARKS}]]]{AFTER_MARK}"
SHOUT_END = r"[!?][\"'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"
SYMBOL_RUN = SYMBOLS + r"{2,}[^\x20\x09-\x0D]*"
BOILERPLATE = (r"(?i)(?:accept|use|uses|using) (?:all )?cookies|enable javascript|all rights reserved|terms of (?:use|service)"
               r"|privacy policy|lorem ipsum|click here|sign up for our newsletter|skip to (?:main )?content")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window occurring twice or more in the array.

    Windows are compared by 64-bit hashes, sorted with their positions, so the work is n log n.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = let(F.array_sort(windows), lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(n < 4, F.lit(0)).otherwise(covered)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def failing(line: Column) -> Column:
    """True for a line that the rules remove."""
    n = _count(line, WORD)
    ends, shouts = _count(line, SENTENCE_END_JAVA), _count(line, SHOUT_END)
    separators, symbols = F.size(F.filter(F.split(line, SPACE), lambda w: w.rlike(r"\A[|»›•·]+\z"))), _count(line, SYMBOL_RUN)
    return let(F.struct(n.alias("n"), ends.alias("e"), shouts.alias("s"), symbols.alias("y")), lambda m: F.when(m["n"] == 0, F.lit(False)).otherwise(
        ((m["e"] == 0) & (m["n"] >= LONG_LINE)) | (2 * m["s"] > m["n"]) | (5 * m["y"] >= m["n"])
        | ((m["n"] < LONG_LINE) & line.rlike(BOILERPLATE))
        | (line.rlike(r"[|»›•·]") & (separators >= 2) & (10 * separators >= m["n"]))))


def base_numbers(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    doubled = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    parts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                                repeated_words(w).cast("long").alias("n_repeat_words")))
    return let(parts, lambda m: F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        doubled.cast("long").alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        ((m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed")))


def cleaned(text: Column) -> Column:
    """Struct of the text without failing lines, how many they are, and how many words are left."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(F.struct(lines.alias("all"), F.filter(lines, lambda s: ~failing(s)).alias("good")), lambda x: let(
        F.struct(F.array_join(x["good"], "\n").alias("text"), (F.size(x["all"]) - F.size(x["good"])).cast("long").alias("lines_removed")),
        lambda y: F.struct(y["text"].alias("text"), y["lines_removed"].alias("lines_removed"), count_words(y["text"]).alias("words_left"))))


def verdict(text: Column) -> Column:
    """Struct: all of base_numbers, the cleaned text, lines_removed, words_left and kept."""
    return let(F.struct(base_numbers(text).alias("b"), cleaned(text).alias("c")), lambda x: F.struct(
        *[x["b"][n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        (~x["b"]["base_failed"] & (100 * (x["b"]["n_words"] - x["c"]["words_left"]) <= MOST_LOST * x["b"]["n_words"])).alias("kept"),
        x["c"]["lines_removed"].alias("lines_removed"), x["c"]["words_left"].alias("words_left"), x["c"]["text"].alias("text")))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the verdict's columns and the cleaned text, one row per document.

    NULL, empty and blank texts have zero words and fail the base rules. Repeated rows are judged alike,
    other columns are ignored, and an empty table gives no rows.
    """
    return docs.select("doc_id", verdict(F.col("text")).alias("v")).select("doc_id", "v.*")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with their failing lines removed and n_chars (if there) counted anew."""
    judged = docs.select(F.struct("*").alias("doc"), verdict(F.col("text")).alias("v")).where("v.kept")
    changed = {"text": F.col("v.text"), "n_chars": F.length("v.text").cast("long")}
    return judged.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])


def oracle(table: str = "documents", columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, words_left", keep: str = "") -> str:
    """judge() in DuckDB SQL, with windows compared as texts; keep names further columns to carry."""
    sql = lambda p: p.replace("'", "''")
    count = lambda p, of="s": f"len(regexp_extract_all({of}, '{sql(p)}'))"
    return f"""
WITH texts AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM texts),
repeated AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS j FROM
  (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1) GROUP BY rid),
judged AS (SELECT *, list_filter(lines, lambda s: regexp_matches(s, '{WORD}')) AS full_lines,
  list_filter(lines, lambda s: NOT ({count(WORD)} > 0 AND (({count(SENTENCE_END)} = 0 AND {count(WORD)} >= {LONG_LINE}) OR 2 * {count(SHOUT_END)} > {count(WORD)}
    OR 5 * {count(SYMBOL_RUN)} >= {count(WORD)} OR ({count(WORD)} < {LONG_LINE} AND regexp_matches(s, '{sql(BOILERPLATE)}'))
    OR (len(list_filter(string_split_regex(s, '{SPACE}'), lambda w: regexp_matches(w, '\\A[|»›•·]+\\z'))) >= 2
        AND 10 * len(list_filter(string_split_regex(s, '{SPACE}'), lambda w: regexp_matches(w, '\\A[|»›•·]+\\z'))) >= {count(WORD)})))) AS good FROM texts),
numbers AS (SELECT doc_id{keep}, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {count(SYMBOLS, "t")}::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(array_to_string(good, chr(10)), '') AS cleaned_text,
  (len(lines) - len(good))::BIGINT AS lines_removed, coalesce(n, 0)::BIGINT AS n_repeat_words FROM judged LEFT JOIN repeated USING (rid)),
verdicts AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {count(WORD, "cleaned_text")}::BIGINT AS words_left FROM numbers)
SELECT {columns} FROM (SELECT *, NOT base_failed AND 100 * (n_words - words_left) <= {MOST_LOST} * n_words AS kept FROM verdicts)"""
