"""Line-first quality rules: failing lines go, then documents that lose too much text go.

A line of a text (split at line feeds) fails if one of these holds; lines without a word never fail:
  * punctuation: no sentence mark stands at the end of a word or of a quotation;
  * repetition: more than half of its words repeat the word before;
  * navigation: three separators or more, and one for every five words or more;
  * symbols: more than three symbols for every ten words;
  * shouting: five words or more, and no lower-case letter although it has letters;
  * boilerplate: at most twenty words, with a phrase of page furniture.
A document is rejected if its base measures fail (too short, or too many words in repeated eight-word windows), or if
more than half of its words stood in failing lines. Everything is computed inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settled, shingle_hashes, words

MIN_WORDS, WINDOW = 20, 8
#: Percentages: repeated words above which a document fails, words lost above which it goes.
MAX_REPEATED, MAX_LOST = 30, 50
SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›·•"
SENTENCE_END = r"[.!?…:;][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
BOILERPLATE = (r"(?i)\b(all rights reserved|privacy policy|terms of (use|service)|cookies?|javascript|lorem ipsum|click here|"
               r"subscribe|log ?in|sign ?(in|up)|read more|share this|follow us)\b")


def _count(of: str, marks: str):
    """How many characters of a set a text column holds."""
    return F.length(of) - F.length(F.translate(F.col(of), marks, ""))


def _lines():
    """All lines with their number of words and whether they fail."""
    def judge(x):
        line, w = x["line"], x["w"]
        n = F.size(w)
        n_in = lambda marks: F.length(line) - F.length(F.translate(line, marks, ""))
        again = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
        bad = (~F.rlike(line, F.lit(SENTENCE_END)) | (2 * again > n)
               | ((n_in(SEPARATORS) >= 3) & (5 * n_in(SEPARATORS) >= n))
               | (10 * n_in(SYMBOLS) > 3 * n) | ((n >= 5) & (F.upper(line) == line) & (F.lower(line) != line))
               | ((n <= 20) & F.rlike(line, F.lit(BOILERPLATE))))
        return F.struct(line.alias("line"), n.alias("n"), ((n > 0) & bad).alias("fails"))
    split = F.transform(F.split("_text", "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("w")))
    return F.transform(split, judge)


def rate(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of docs), ``doc_id``, the measures, ``kept`` and ``clean_text``, one row per row.

    Null and empty texts have no word and fail; repeated rows are judged alike; very long texts are judged whole;
    columns of docs keep their names inside ``row``, so none can clash; an empty table gives no rows.
    """
    of = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    of = of.withColumn("_words", words(F.col("_text"))).withColumn("_lines", _lines())
    of = shingle_hashes(of, "_words", WINDOW, "_windows")
    # Windows found twice: sort (hash, place), keep places with an equal neighbour; each covers up to the next one.
    of = of.withColumn("_again", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN "
        "sort_array(zip_with(_windows, sequence(1, size(_windows)), (h, i) -> struct(h, i))) END"))
    of = of.withColumn("_again", F.expr(
        "sort_array(filter(transform(_again, (x, k) -> CASE WHEN x.h = get(_again, k - 1).h OR x.h = get(_again, k + 1).h THEN x.i END), "
        "i -> i IS NOT NULL))"))
    of = of.withColumn("n_repeat_words", F.expr(
        f"CASE WHEN size(_again) > 0 THEN aggregate(zip_with(_again, slice(_again, 2, size(_again)), "
        f"(a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x) ELSE 0L END"))
    of = (of.withColumn("n_words", F.size("_words").cast("long"))
          .withColumn("word_chars", F.length(F.translate(F.col("_text"), " \t\n\x0b\f\r", "")).cast("long"))
          .withColumn("n_symbols", _count("_text", SYMBOLS).cast("long"))
          .withColumn("_full", F.expr("transform(filter(_lines, l -> l.n > 0), l -> l.line)"))
          .withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
          .withColumn("n_failed_lines", F.expr("cast(size(filter(_lines, l -> l.fails)) AS bigint)"))
          .withColumn("n_lost_words", F.expr("aggregate(_lines, 0L, (s, l) -> s + IF(l.fails, l.n, 0))"))
          .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
          .withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST * F.col("n_words")))
          .withColumn("clean_text", F.expr("array_join(transform(filter(_lines, l -> NOT l.fails), l -> l.line), '\n')")))
    return of.drop("_text", "_words", "_lines", "_windows", "_again", "_full")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, in the columns of docs (``n_chars`` follows the text if it is there)."""
    kept = settled(rate(docs).select("row", "kept", "clean_text")).where("kept")
    return kept.select(*(F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast("long").alias(c)
                         if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))
