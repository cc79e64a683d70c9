"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import free_names

_SPACES = r"[\x20\x09-\x0D]+"
_WORDED = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects a text where `rejects` is true; `rejects` reads the text column and the counts it names in `needs`,
    which are worked out anew where the rule's cost is measured."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()


def word_array(text: Column) -> Column:
    """Words between blanks; none for a null, empty or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")


def repeated_words(words: str) -> Column:
    """Words that lie in a window of three words which occurs twice or more; reads the array column `words`.

    Windows are sorted with their places, so that equal ones are neighbours; each repeated place then covers three
    words or as many as lie before the next. Time grows as n log n, memory as n.
    """
    n = F.size(words)
    # A function of the element and its index sees the two words that follow through the array itself.
    windows = F.array_sort(F.transform(F.slice(F.col(words), 1, n - 2), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)).alias("w"), i.alias("i"))))
    return F.when(n >= 4, windows)


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Null texts count as empty; columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines, windows, places = free_names(df, "words", "lines", "windows", "places")
    made = df.withColumns({words: word_array(F.col(text_col)), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORDED))})
    made = made.withColumn(windows, repeated_words(words))
    same = lambda x, i: (F.get(F.col(windows), i - 1)["w"] == x["w"]) | (F.get(F.col(windows), i + 1)["w"] == x["w"])
    made = made.withColumn(places, F.array_sort(F.transform(F.filter(windows, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return made.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop(words, lines, windows, places)


def base_failed() -> Column:
    """Under 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules(text_col: str = "text") -> list[Rule]:
    """Rules over the counts and the text, after published web-corpus heuristics; each is false for an empty text."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    text = F.coalesce(F.col(text_col), F.lit(""))
    only = F.regexp_replace(text, r"\P{L}++", "")
    letters = F.length(only)
    capitals = letters - F.length(F.regexp_replace(only, r"\p{Lu}++", ""))
    return [
        Rule("mean_word_length", (F.col("n_words") > 0) & ((mean < 2) | (mean > 16)), ("n_words", "word_chars")),
        Rule("symbols", 10 * F.col("n_symbols") > words, ("n_words", "n_symbols")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.greatest(F.size(F.split(text, "\n")), F.lit(1)), ("n_dup_lines",)),
        Rule("few_letters", 2 * letters < F.length(text)),
        Rule("capitals", 2 * capitals > F.greatest(letters, F.lit(1))),
        Rule("exclamations", 5 * F.regexp_count(text, F.lit("!")) > words, ("n_words",)),
    ]


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate_rules(texts: DataFrame, rules: list[Rule], text_col: str = "text", runs: int = 3) -> list[RuleEstimate]:
    """Each rule's time and share of rejections over a sample of texts, in the order in which they should run.

    A rule is run over the bare texts, so that its time holds the counts that it needs (Spark leaves out the others);
    the least of some runs counts, less that of a job that only counts the texts' bytes. An empty sample leaves the
    given order.
    """

    def least(job: DataFrame) -> tuple[float, Row]:
        took = []
        for _ in range(runs):
            t = time.perf_counter()
            row = job.first()
            took.append(time.perf_counter() - t)
        return min(took), row

    counted, n = text_counts(texts, text_col), F.count(F.lit(1)).alias("n")
    idle, _ = least(texts.agg(n, F.sum(F.octet_length(text_col)).alias("k")))
    out = []
    for r in rules:
        seconds, row = least(counted.agg(n, F.count_if(F.coalesce(r.rejects, F.lit(False))).alias("k")))
        out.append(RuleEstimate(r.name, max(seconds - idle, 1e-4), row["k"] / row["n"] if row["n"] else 0.0))
    return sorted(out, key=lambda e: -e.worth)


def cascade(rules: list[Rule], order: list[RuleEstimate]) -> Column:
    """Name of the first rule of the order that rejects, null if none: a CASE, so later rules aren't evaluated."""
    by = {r.name: r for r in rules}
    out = None
    for e in order:
        hit = F.coalesce(by[e.name].rejects, F.lit(False))
        out = F.when(hit, F.lit(e.name)) if out is None else out.when(hit, F.lit(e.name))
    return F.lit(None).cast("string") if out is None else out


def quality_cascade(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000, sample_fraction: float = 0.05) -> DataFrame:
    """df with the counts, base_failed and kept.

    kept is false where base_failed, else where any rule rejects; the rules' order comes from a sample of at most
    sample_rows rows and changes the cost only, never the verdict. A null or empty text has no words and fails the
    base, whose two rules stand before the cascade. Repeated rows are judged alike; an empty table gives no rows; columns with an output's name are replaced.
    """
    rules = standard_rules(text_col) if rules is None else rules
    few = df.select(text_col).sample(fraction=sample_fraction, seed=11).limit(sample_rows).cache()
    order = estimate_rules(few, rules, text_col)
    few.unpersist()
    return text_counts(df, text_col).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order).isNull()))
