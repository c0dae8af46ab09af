"""Quality rules: a table of thresholds compiled into Spark projections.

Everything is built-in functions on the JVM side: one scan, no shuffle, no Python.

Defined results: NULL text counts as empty; an empty text has zero counts, ratios of 0
and fails the base rule. Each input row gives one row, so repeated rows repeat; an empty
table gives an empty one. Columns other than the id and the text are not read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
# Up to so many repeated windows of a text are looked up one by one; a matter of speed only.
LOOKED_UP = 32

# Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is it that was for on are as with at by be this from or an have not "
    "le la les de des et un une en du que qui dans pour est il au avec sur pas par ne se "
    "el los las y en que un una por con para es al lo como del su no "
    "der die das und ist im von den mit zu ein eine auf für nicht dem des sich es an"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes while the metric lies within the bounds; a bound of None does not hold."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        value = F.col(self.metric)
        bounds = []
        if self.low is not None:
            bounds.append(value < F.lit(self.low))
        if self.high is not None:
            bounds.append(value > F.lit(self.high))
        if not bounds:
            return F.lit(False)
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]


RULES = (
    Rule("words", "n_words", low=BASE_MIN_WORDS),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbols_per_word", high=0.15),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("table_lines", "table_line_ratio", high=0.5),
    Rule("shouted_words", "shouted_ratio", high=0.5),
)

RATIOS = ("mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio",
          "table_line_ratio", "shouted_ratio")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def _repeated_places(hashes: str, repeated: str) -> Column:
    """Ascending first positions of the windows whose hash occurs twice or more.

    With few repeated hashes every window is looked up among them; with many, the windows
    are sorted with their positions. Both give the same places.
    """
    h, r = F.col(hashes), F.col(repeated)
    looked_up = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, h[i]))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def shared(ordered: Column) -> Column:
        def near(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ordered, i - 1)["h"] == x["h"]).otherwise(False)
            return before | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, near), lambda x: x["p"]))

    # The one-element array names the sorted pairs, so that they are sorted once.
    sorted_out = F.transform(F.array(pairs), shared)[0]
    return (F.when(F.size(r) == 0, F.array().cast("array<int>"))
            .when(F.size(r) <= LOOKED_UP, looked_up).otherwise(sorted_out))


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every text.

    Three-word windows are compared by a 64-bit hash: in a text of n words, two different
    windows pass for equal with a probability below n * n / 2**65. They are sorted, so the
    work is n log n in the words of a text. Each step is a projection of its own that reads
    the one before more than once: the optimizer then keeps it apart and evaluates it once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    words, size = F.col("words"), F.size("words")
    starts = F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    counted = split.select(
        "doc_id", "n_symbols",
        size.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.contains(x, F.lit("|")))).cast("long").alias("n_table_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)))
        .cast("long").alias("n_shouted"),
        F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])).alias("hashes"),
    )
    ordered = counted.withColumn("ordered", F.sort_array("hashes"))
    repeated = ordered.withColumn("repeated", F.array_distinct(F.filter(
        "ordered", lambda h, i: F.when(i > 0, F.get("ordered", i - 1) == h).otherwise(False))))
    placed = repeated.withColumn("places", _repeated_places("hashes", "repeated"))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "places", none,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"),
        _share("word_chars", "n_words").alias("mean_word_chars"),
        _share("n_symbols", "n_words").alias("symbols_per_word"),
        _share("n_stop_words", "n_words").alias("stop_word_ratio"),
        _share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _share("n_table_lines", "n_lines").alias("table_line_ratio"),
        _share("n_shouted", "n_words").alias("shouted_ratio"),
    )


def apply_rules(metrics: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    base = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")
    )
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    broken = broken if rules else F.array().cast("array<string>")
    judged = metrics.withColumns({"base_failed": base, "failed_rules": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics and verdict of every document."""
    return apply_rules(quality_metrics(docs, id_col, text_col), rules)
