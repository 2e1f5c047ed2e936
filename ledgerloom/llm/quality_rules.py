"""Quality rules [native]: a threshold table compiled into one Spark projection, without user functions.

Every measure comes from the row alone, so the plan is one scan and projections: no shuffle, no Python. Repeated
8-word windows are found inside the row: windows are hashed, and only texts in which a hash occurs twice sort their
windows, compare neighbours with equal hashes word by word, and add up the words that the repeated ones cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_or_empty

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Common words of the corpus's languages, as written inside and at the start of a sentence.
STOP_WORDS = (
    "the of and to in is was for that it with as on be by at are this from or an a not have he "
    "le la les de des du et un une en que qui dans pour est sur par pas au ce il ne se "
    "der die das und ist von den zu mit ein eine nicht auf für im dem als auch es sich "
    "el los las y en que un una por con para del se no su al lo como más"
)

#: Rules as (measure, least, most); None is no bound. Measures are the columns that measures() makes.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.1),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_ratio", None, 0.3),
)


def _either(test: Column, value: Column, kind: str) -> Column:
    return F.when(test, value).otherwise(F.lit(None).cast(kind))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, per whole text, counts and ratios; null texts count as empty and have ratios of 0."""
    stops = sorted({x for w in STOP_WORDS.split() for x in (w, w.capitalize())})
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text_or_empty(text_col).alias("text"),
        F.array_remove(F.split(text_or_empty(text_col), f"{WHITE}+"), "").alias("words"),
    )
    n = F.size("words")
    counted = split.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _either(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
            "array<bigint>",
        ).alias("windows"),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    lined = counted.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _either(
            again,
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            "array<struct<h:bigint,i:int>>",
        ).alias("ordered"),
    )

    def same(x: Column, other: Column) -> Column:
        return (other["h"] == x["h"]) & (F.slice("words", other["i"] + 1, WINDOW) == F.slice("words", x["i"] + 1, WINDOW))

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("ordered", k - 1), F.get("ordered", k + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    found = lined.withColumn("starts", F.sort_array(F.transform(F.filter("ordered", twice), lambda x: x["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["words"] + WINDOW - F.greatest(a["end"] - s, F.lit(0))).alias("words"), (s + WINDOW).alias("end")
        ),
        lambda a: a["words"],
    )
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression over measures()."""
    tests = [F.col(m) >= least for m, least, _ in rules if least is not None]
    tests += [F.col(m) <= most for m, _, most in rules if most is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def broken(rules=RULES) -> Column:
    """The names of the rules that a row breaks, in the table's order."""
    names = [F.when(~compiled([r]), F.lit(r[0])) for r in rules]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the measures, base_failed, kept, and the broken rules.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. A null or blank text has no
    words and fails. Repeated rows give repeated results, an empty table none; a null id is passed on and other
    columns are ignored.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measures(docs, id_col, text_col).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & compiled(rules)).withColumn("broken_rules", broken(rules))


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, range({WINDOW}) AS r(k) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: list_contains([{", ".join(repr(x) for w in STOP_WORDS.split() for x in (w, w.capitalize()))}], w))) AS n_stop_words,
         len(lines) AS n_lines
  FROM split s LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1
       AND n_stop_words / n_words >= 0.02 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.4
       AND n_repeat_words / n_words <= 0.3 AS kept
FROM judged
"""
