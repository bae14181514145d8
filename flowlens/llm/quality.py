"""Quality rules, lines first.

Counts of the whole text (words, symbols, repeated lines, words in repeated five-word windows) give
the base verdict. Then every line is judged by its punctuation, as navigation and as boilerplate;
failing lines go, and a document that loses too much of its text with them is rejected; notices
such as a licence line are no text of its own, and losing them does not count. Everything is computed from the row alone by built-in functions: one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, nested, once, text_or_empty, words

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
LEAST_LEFT = 0.5  # of the words' characters outside notices, after lines are removed
SYMBOLS = "#*$%&|<>"

# Rules for lines.
ENDINGS = r"[.!?:;…。！？»”’\"')\]]$"
SEPARATOR = r"[|›»•·>/~-]+"  # a word of these signs alone
DOUBLED = r"[!?#*$%&|<>]{2,}"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|licensed under|released under the|general public license|terms of (?:use|service)"
               r"|privacy policy|cookie policy|use cookies|enable javascript|click here|sign in|log in|subscribe to)\b")
SHORT_LINE = 4  # words a line may have at most to need an end mark
BOILERPLATE_WORDS = 20  # a longer line with such a phrase is running text


def repeated_windows(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the windows' hashes in order.

    Most texts have none, which a set of the hashes shows; else the (hash, place) pairs are sorted,
    equal neighbours give the repeated places, and each place covers the words up to the next.
    """
    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def places(p: Column) -> Column:
            n = F.size(p)
            again = F.filter(p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(p, j + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(again, lambda x: x["i"]))
        def total(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"]
        return _let(_let(pairs, places), total)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text_or_empty("text")
    rows = once(docs, _words=words(text), _lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    rows = once(rows, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    rows = once(rows, _windows=F.when(
        F.size("_hashes") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.slice("_hashes", F.lit(1), F.size("_hashes") - (WINDOW - 1)),
            lambda h, i: F.xxhash64(h, *[F.get("_hashes", i + k) for k in range(1, WINDOW)]))))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_windows(F.col("_windows")).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return once(rows, base_failed=failed)


def line_verdict(line: Column) -> Column:
    """(line, notice, fails) of a line; one without a word does not fail.

    It fails as menu-like (a few words without an end mark), as symbols for punctuation, as
    navigation (words of separators alone), or as a notice: a few words of boilerplate.
    """
    def judged(n: Column) -> Column:
        notice = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        bare = (n < SHORT_LINE) & ~F.rtrim(line).rlike(ENDINGS)
        doubled = F.regexp_count(line, F.lit(DOUBLED)) * 10 > n * 3
        some = line.rlike(rf"(?:^|\s){SEPARATOR}")  # most lines need no look at every word
        separators = F.when(some, F.size(F.filter(words(line), lambda w: w.rlike(f"^(?:{SEPARATOR})$")))).otherwise(0)
        navigation = (separators >= 3) & (separators * 5 >= n)
        return F.struct(line.alias("line"), notice.alias("notice"), ((n > 0) & (bare | doubled | navigation | notice)).alias("fails"))

    return _let(F.regexp_count(line, F.lit(WORD)), judged)


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, ``kept`` and ``clean_text`` (the text without its failing lines).

    A null or empty text has no words, fails and keeps an empty clean text. Rows are judged one by
    one, so repeated rows and ties get the same verdict. ``verdicts`` and ``clean`` read no other columns.
    """
    lines = F.split(text_or_empty("text"), "\n")
    none = F.array().cast("array<struct<line:string,notice:boolean,fails:boolean>>")
    rows = with_counts(docs).drop("_lines")
    rows = once(rows, _judged=F.when(F.col("base_failed"), none).otherwise(F.transform(lines, line_verdict)))

    def chars(wanted) -> Column:
        said = F.array_join(F.transform(F.filter("_judged", wanted), lambda x: x["line"]), "")
        return F.length(F.translate(said, " \t\n\x0b\f\r", ""))

    good = F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"])
    clean = F.when(F.col("base_failed"), text_or_empty("text")).otherwise(F.array_join(good, "\n"))
    left, own = chars(lambda x: ~x["fails"]), F.col("word_chars") - chars(lambda x: x["notice"])
    kept = ~F.col("base_failed") & (left > 0) & (left >= LEAST_LEFT * own)
    return rows.withColumn("clean_text", clean).withColumn("kept", kept).drop("_judged")


def verdicts(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed and kept."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with their cleaned text; ``n_chars`` follows it."""
    rows = judged(nested(docs, text=F.col("text"))).where("kept")
    cols = [F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
            for c, t in docs.dtypes]
    return rows.select(*cols)
