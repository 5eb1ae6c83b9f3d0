"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is it for was on as by at from or an this "
    "le la les de des du et en un une est que qui dans pour sur avec il elle par au "
    "der die das und ist nicht von mit den ein eine zu auf des im dem sich als auch "
    "el los las y con se su por es una no lo al para como del"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a row when 100 * measure lies within low and high times the base measure."""

    name: str
    measure: str
    base: str
    low: int | None
    high: int | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression over the measure columns."""
    verdict = F.lit(True)
    for r in rules:
        value = F.col(r.measure) * 100
        if r.low is not None:
            verdict &= value >= F.col(r.base) * r.low
        if r.high is not None:
            verdict &= value <= F.col(r.base) * r.high
    return verdict


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its measures; the row itself is in the struct `_row`.

    n_words, word_chars (code points in words), n_symbols, n_stop_words, n_lines (lines with
    a word), n_dup_lines (those equal to an earlier line), n_repeat_words (words in three-word
    windows found twice or more). Null and empty texts measure zero throughout. All lists stay
    inside their row: nothing is shuffled. Repeated windows are neighbours after sorting.
    """
    blank = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), blank.alias("_t"), words(F.col(text)).alias("_w"))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_w")
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, F.slice("_w", F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.select(
        "_row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(F.filter("_w", lambda x: F.rtrim(x, F.lit(".,;:")).isin(stop))).cast("long").alias("n_stop_words"),
        lines.alias("_lines"),
        F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("_g"),
    )
    keyed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    rows = rows.select(
        *(c for c in rows.columns if c not in ("_lines", "_g")),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(some, keyed).alias("_s"),
    )
    starts = F.flatten(
        F.zip_with(
            F.slice("_s", F.lit(1), F.size("_s") - 1),
            F.slice("_s", F.lit(2), F.size("_s") - 1),
            lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    return rows.select(*(c for c in rows.columns if c != "_s"), F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Measures, base_failed and kept for each row, with the row in `_row`.

    base_failed: fewer than min_words words, or more than max_repeat_percent percent of them
    in repeated windows; null and empty texts fail. kept: not base_failed and within every
    rule. Repeated rows get equal verdicts, ties do not matter, an empty table stays empty.
    """
    measured = measure(docs, text)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """The rows that pass, with their own columns only.

    The row number keeps the filter above the projection: pushed below, it would repeat the
    whole of it for every measure that it reads.
    """
    judged = apply_rules(docs, text, **params).withColumn("_at", F.monotonically_increasing_id())
    return judged.where("kept AND _at >= 0").select("_row.*")
