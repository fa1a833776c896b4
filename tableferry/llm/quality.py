"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2000


class Rule(NamedTuple):
    """A rule rejects a document where ``fails`` is true; it may use the text and the base columns."""

    name: str
    fails: Column


def rules(text: str = "text") -> list[Rule]:
    """The rules of the cascade; thresholds are far from ordinary prose."""
    t = F.col(text)
    words = F.col("n_words")
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return [
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("symbols", 4 * F.col("n_symbols") > words),
        Rule("repeated_lines", 3 * F.col("n_dup_lines") > lines),
        Rule("letters", F.regexp_count(t, F.lit(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])")) * 10 > words * 4),
        Rule("bullets", 10 * F.regexp_count(t, F.lit(r"(?m)^[\x20\x09]*[-*•]")) > 9 * lines),
        Rule("ellipsis", 10 * F.regexp_count(t, F.lit(r"(?m)(\.\.\.|…)[\x20\x09]*$")) > 3 * lines),
    ]


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, all from the whole text.

    A word is a run of anything but ASCII white space.  n_repeat_words counts
    the words that lie in a window of three words found twice or more in the
    text.  A NULL text has no words, and fails.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    df = docs.withColumn("_words", words)
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    # equal windows have equal hashes: a text whose hashes all differ has no repeated window
    spots = F.when(F.col("n_words") >= 3, F.sequence(F.lit(1), F.size("_words") - 2)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.element_at("_words", i)
    df = df.withColumn("_hashes", F.transform(spots, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    clean = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    sorted_windows = F.array_sort(F.transform(spots, lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i"))))
    df = df.withColumn("_windows", F.when(~clean, sorted_windows))
    near = lambda i: F.get("_windows", i)["w"]
    twice = F.filter(F.transform("_windows", lambda x, i: F.when((x["w"] == near(i - 1)) | (x["w"] == near(i + 1)), x["i"])), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("n_repeat_words", F.when(F.col("_windows").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    df = df.select(
        *[f"`{c}`" for c in docs.columns],
        "n_words",
        (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def ordered_rules(measured: DataFrame, chosen: Sequence[Rule], rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) of every rule on a sample of about ``rows`` rows, best rejection per second first.

    The sample is held by Spark while each rule is timed over it.  The order decides only how much work is done, never the verdict.
    """
    total = max(measured.count(), 1)
    sample = measured.sample(min(1.0, rows / total), seed).persist()
    try:
        seen = max(sample.count(), 1)
        base = _timed(sample, F.lit(False))[1]
        found = []
        for rule in chosen:
            rejected, seconds = _timed(sample, rule.fails)
            found.append((rule, rejected / seen, max(seconds - base, 1e-3)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def _timed(sample: DataFrame, fails: Column) -> tuple[int, float]:
    start = time.perf_counter()
    rejected = sample.agg(F.count_if(fails)).first()[0]
    return rejected, time.perf_counter() - start


def cascade(measured: DataFrame, order: Sequence[Rule], rejected_by: str = "rejected_by") -> DataFrame:
    """Add kept and the name of the first rule that rejects; a rule is not evaluated once an earlier one rejects.

    A base failure comes first and has the name ``base``.  A rule that is NULL for a row does not reject it.
    """
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    out = measured.withColumn(rejected_by, verdict)
    return out.withColumn("kept", F.col(rejected_by).isNull())


def judged(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``docs`` with the base measures, rejected_by and kept.

    Costs are learned from raw rows: the sample is drawn before the measures are
    taken, so that only it is measured for the estimate.  An empty table gives an empty result.
    """
    total = max(docs.count(), 1)
    drawn = docs.sample(min(1.0, rows / total), 11)
    order = ordered_rules(base_measures(drawn, text), rules(text), rows)
    return cascade(base_measures(docs, text), [r for r, _, _ in order])
