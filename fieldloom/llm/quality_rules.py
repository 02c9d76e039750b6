"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are taken of every whole text; a document that fails the base is not kept. The rules follow. On a bounded sample each
rule is timed and its rejections are counted, and the rules then stand in one CASE by rejections per second: a row's later rules
are not computed once one rejects it. The order changes the cost, never the verdict.

Words are runs without ASCII white space. Repeated three-word windows are found by 64-bit hashes of word hashes. Defined results:
null text has no words and fails the base; repeated rows have equal verdicts; rules with equal rates stand by name; an empty table gives an
empty table; texts of any length are counted whole; the columns of the table stay apart from the counts, in ``row``, so names may clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, let, staged, text_of

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Rows, at most about, on which costs and rejections are estimated.
SAMPLE_ROWS = 2_000
#: How often the sample is gone through for one timing, so that a rule's own time stands above a job's noise, and timings of which the least counts.
PASSES, TIMINGS = 8, 2


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "")


def repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the array of word hashes."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def places(ordered: Column) -> Column:
        """Places of the windows whose hash has an equal neighbour in the order of hashes."""
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        """Each place covers three words, or as many as lie before the next place."""
        each = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x)

    ordered = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(ordered(w), lambda o: let(places(o), covered))).otherwise(0)
    return F.when(n >= 3, let(windows, repeated)).otherwise(0)


def counts(text: Column, windows: bool = True) -> Column:
    """n_words, n_repeat_words (0 without ``windows``), word_chars, n_symbols, n_lines and n_dup_lines as a struct."""
    long = lambda c, name: c.cast("bigint").alias(name)
    if windows:
        hashed = F.transform(_words(text), lambda w: F.xxhash64(w))
        of_words = let(hashed, lambda h: F.struct(long(F.size(h), "n_words"), long(repeat_words(h), "n_repeat_words")))
    else:
        of_words = F.struct(long(F.size(_words(text)), "n_words"), long(F.lit(0), "n_repeat_words"))
    of_lines = let(_lines(text), lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    return F.struct(of_words.alias("words"), long(F.length(text) - _count(text, SPACE), "word_chars"), long(_count(text, SYMBOLS), "n_symbols"), of_lines.alias("lines"))


def with_counts(df: DataFrame, text: str = "text", windows: bool = True) -> DataFrame:
    """The counts of a text column without nulls as columns. They come out of a generator, below which no filter is moved."""
    df = df.select("*", F.inline(F.array(counts(F.col(text), windows))))
    return df.select("*", "words.*", "lines.*").drop("words", "lines")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to drop; it may use text and the counts."""

    name: str
    rejects: Column


def rules(text: str = "text") -> list[Rule]:
    t = F.col(text)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 15 * F.col("n_words")),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("capitals", 10 * capitals > 4 * letters),
        Rule("exclamations", 5 * _count(t, "!") > F.col("n_words")),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejections_per_second(texts: DataFrame, some: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float]]:
    """Each rule with its rejections per second of its own time on a sample of column ``text``, best first."""
    total = texts.count()
    if not total:
        return [(r, 0.0) for r in some]
    # The rows that the cascade sees: those that pass the base.
    sample = with_counts(texts.select("text").sample(min(1.0, rows / total), seed=7))
    sample = staged(sample.filter(~base_failed()).repartition(4), "rule-sample")
    again = sample.withColumn("_pass", F.explode(F.array(*map(F.lit, range(PASSES)))))

    def timed(condition: Column) -> tuple[float, int]:
        begun = time.perf_counter()
        found = again.agg(F.count_if(condition).alias("n")).first()["n"]
        return time.perf_counter() - begun, found // PASSES

    floor = min(timed(F.length("text") + F.col("_pass") < 0)[0] for _ in range(TIMINGS + 1))
    rates = []
    for rule in some:
        timings = [timed(rule.rejects) for _ in range(TIMINGS)]
        rates.append((rule, timings[0][1] / max(min(s for s, _ in timings) - floor, 1e-3)))
    discard(sample)
    return sorted(rates, key=lambda x: (-x[1], x[0].name))


def first_rejection(ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null. CASE computes no rule after that."""
    case = F.when(F.lit(False), F.lit(""))
    for rule in ordered:
        case = case.when(rule.rejects, F.lit(rule.name))
    return case


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, the counts, base_failed and kept."""
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    ordered = [r for r, _ in rejections_per_second(rows, rules(), sample_rows)]
    counted = with_counts(rows).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(first_rejection(ordered).isNull())
    return counted.withColumn("kept", kept).drop("text")
