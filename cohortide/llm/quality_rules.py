"""Quality rules by DataFrame functions: lines are judged first, then the document by what is left.

A line fails a rule for punctuation (runs of marks on many words, symbol runs on many words, a
fragment without closing mark), navigation (a bar for every few words) or boilerplate (a short line
with a set phrase, one word over and over, or a copy of an earlier line). The document is kept if it
passes the base rules and failing lines hold at most ``max_lost`` percent of its words.

Every step is a row-wise expression, so nothing is shuffled and a document never leaves its task.
Repeated windows are found by sorting hashes within the document, and only where some repeat.

Cases: a null or empty text has no words and fails the base rules. Repeated rows give a row each,
nulls and ties in other columns do not matter, and they are not looked at. A very long text is one
row with arrays of its words. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (r"(?i)cookie|privacy policy|terms of (use|service)|click here|sign up|log ?in|"
               r"javascript|subscribe|all rights reserved|share this|read more")
#: Percent of words that failing lines may hold.
MAX_LOST = 40


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_passes(line: Column) -> Column:
    """Whether a line of at least one word is prose."""
    n = count(line, WORD)
    marks = count(line, r"[!?]{2,}") * 10 <= n
    symbols = count(line, r"[#*$%&<>]+(\s|$)") * 10 <= n
    closed = (n >= 3) | line.rlike(r"[.!?:;…\"')\]]\s*$")
    bars = count(line, r"[|»·]") * 5 < n + 5
    phrase = (n > 20) | ~line.rlike(BOILERPLATE)
    varied = (n < 10) | ~line.rlike(r"(^|\s)(\S+)(\s+\2){4}(\s|$)")
    return bars & marks & symbols & closed & phrase & varied


def document_rules(docs: DataFrame, max_lost: int = MAX_LOST, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Counts, verdicts and the cleaned text (passing lines, each once) of every document."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select("doc_id", "t", F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
                       lines.alias("lines"))
    n = F.size("words")
    word = lambda i, k: F.get("words", i + k)
    windows = F.when(n >= 5, F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.xxhash64(*[word(i, k) for k in range(5)])))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"), F.array_distinct("lines").alias("lines"),
        windows.alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(repeats, pairs)).drop("windows")
    beside = lambda x, k: F.get("sorted", k)["h"] == x["h"]
    twice = F.transform("sorted", lambda x, k: F.when(
        F.coalesce(beside(x, k + 1), F.lit(False))
        | (k > 0) & beside(x, F.greatest(k - 1, F.lit(0))), x["i"]))
    rows = rows.withColumn("starts", F.array_sort(F.array_compact(twice))).drop("sorted")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("starts", zero, lambda s, i: F.struct(
        (s["n"] + i + 5 - F.greatest(i, s["end"])).alias("n"), (i + 5).alias("end")), lambda s: s["n"])
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.col("n_lines") - F.size("lines")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("lines", line_passes).alias("good"))
    left = F.aggregate("good", F.lit(0).cast("long"), lambda s, x: s + count(x, WORD))
    rows = rows.withColumn("n_left", left)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("n_left")) > max_lost * F.col("n_words")
    return rows.select(
        F.col("doc_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_left",
        F.array_join("good", "\n").alias("clean_text"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT *, CASE WHEN len(words) >= 5 THEN
         list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
         ELSE [] END AS grams FROM w),
r AS (
  SELECT doc_id, i, j FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
      SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g)),
    (SELECT unnest(range(5)) AS j) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r GROUP BY doc_id),
l AS (
  SELECT doc_id, sum(n) AS n FROM (
    SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, unnest(list_distinct(lines)) AS x FROM g))
  WHERE len(regexp_extract_all(x, '[|»·]')) * 5 < n + 5
    AND len(regexp_extract_all(x, '[!?]{2,}')) * 10 <= n
    AND len(regexp_extract_all(x, '[#*$%&<>]+(\s|$)')) * 10 <= n
    AND (n >= 3 OR regexp_matches(x, '[.!?:;…"'')\]]\s*$'))
    AND (n > 20 OR NOT regexp_matches(x, '(?i)cookie|privacy policy|terms of (use|service)|click here|sign up|log ?in|javascript|subscribe|all rights reserved|share this|read more'))
    AND (n < 10 OR NOT list_has_any(list_transform(range(1, n - 3), lambda i: len(list_distinct(
         regexp_extract_all(x, '[^\x20\x09-\x0D]+')[i:i+4])) = 1), [true]))
  GROUP BY doc_id),
m AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_left
  FROM g LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * (n_words - n_left) <= 40 * n_words AS kept
FROM m
"""
