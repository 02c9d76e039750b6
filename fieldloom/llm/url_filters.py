"""URL verdicts: rules first, else host word segmentation and multinomial naive Bayes.

A unigram model is counted over the words of all pages. Runs of letters in host names are split by Viterbi into the likeliest words;
only words that are parts of some host name are looked up, by a join on all such parts. Hosts whose words include a seed word of
unwanted sites teach naive Bayes the block class, all others the allow class, over the segmented words of host and path. Scores are
computed once per distinct host and path words, and joined back.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, has no words, and is allowed; a null html has
no words; repeated rows give equal verdicts; rules of equal length go by their text; an empty table gives an empty table; host names of
any length are split whole, a run longer than a label of a domain name in words of at most ``LONGEST`` letters; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import rows_by_key, staged

#: Letters of the longest word that a host name can hold: the limit on a label of a domain name.
LONGEST = 63
#: Count that a seed word has besides those of the pages.
SEED_COUNT = 1_000
SMOOTHING = 1.0
# Words that mark unwanted sites.
SEEDS = ("adult", "bet", "betting", "casino", "cheap", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame) -> DataFrame:
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Columns rule and verdict of the longest (verdict, ``host/path``) rule that fits, else null."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def runs(column: Column) -> Column:
    """Runs of ASCII letters, in lower case."""
    return F.filter(F.split(F.translate(column, UPPER, LOWER), "[^a-z]+"), lambda w: w != "")


def split_word(run: str, counts: dict[str, int], total: int) -> list[str]:
    """Viterbi: the likeliest words; one that is not known costs more by its length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for begin in range(max(0, end - LONGEST), end):
            n = counts.get(run[begin:end])
            cost = math.log(total) - math.log(n) if n else math.log(total) + math.log(10) * (end - begin)
            options.append((best[begin][0] + cost, begin))
        best.append(min(options))
    words, end = [], len(run)
    while end:
        begin = best[end][1]
        words.append(run[begin:end])
        end = begin
    return words[::-1]


def segmented(names: DataFrame, pages: DataFrame) -> DataFrame:
    """run, words for every distinct run of letters in column ``run`` of ``names``."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<[^>]*>", " ")
    words = pages.select(F.explode(runs(plain)).alias("word")).filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    seeds = names.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SEEDS], "word string, n long")
    words = staged(words.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "page-words")
    total = words.agg(F.sum("n")).first()[0]
    size = F.length("run")
    starts = names.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    longest = F.least(F.lit(LONGEST), size - F.col("at") + 1)
    parts = starts.select("run", F.explode(F.transform(F.sequence(F.lit(1), longest), lambda k: F.substring("run", F.col("at"), k))).alias("word")).distinct()
    # A run without any known part still has its row.
    known = parts.join(words, "word", "left").select("run", F.when(F.col("n").isNotNull(), F.col("word")).alias("word"), "n").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows_by_key(batches, ["run"]):
            run = group["run"][0].as_py()
            counts = {w: n for w, n in zip(group["word"].to_pylist(), group["n"].to_pylist(), strict=True) if w}
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.string()), pa.array([split_word(run, counts, total)], pa.list_(pa.string()))], ["run", "words"])

    return known.repartition("run").sortWithinPartitions("run").mapInArrow(split, "run string, words array<string>")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (of block; null if the page has no words)."""
    rows = with_host_path(pages.select("page_id", "url", "html"))
    rows = rows.withColumn("path_words", F.array_join(runs(F.col("path")), " "))
    # How many pages each distinct host and path words have: the unit that is segmented and scored.
    units = staged(rows.groupBy("host", "path_words").agg(F.count("*").alias("pages")), "url-units")
    pieces = units.select("host", "path_words", "pages", F.posexplode(runs(F.col("host"))).alias("at", "run"))
    words = staged(segmented(pieces, pages), "host-words")
    of_host = pieces.join(words, "run").select("host", "path_words", "pages", F.explode("words").alias("word"))
    of_path = units.select("host", "path_words", "pages", F.explode(F.split("path_words", " ")).alias("word")).filter("word <> ''")
    unwanted = of_host.groupBy("host", "path_words").agg(F.max(F.col("word").isin(*SEEDS)).alias("unwanted"))
    tokens = staged(of_host.unionByName(of_path).join(unwanted, ["host", "path_words"], "left").fillna(False, ["unwanted"]), "url-tokens")
    # Naive Bayes: words by class, weighted by pages.
    by_word = tokens.groupBy("word").agg(F.sum(F.when(F.col("unwanted"), F.col("pages")).otherwise(0)).alias("b"), F.sum(F.when(F.col("unwanted"), 0).otherwise(F.col("pages"))).alias("a"))
    sums = by_word.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    of_class = units.join(unwanted, ["host", "path_words"], "left").agg(F.sum(F.when(F.col("unwanted"), F.col("pages")).otherwise(0)).alias("b"), F.sum("pages").alias("all")).first()
    n_block, n_all = of_class.b or 0, of_class["all"] or 0
    prior = math.log((n_block + 1) / (n_all - n_block + 1))
    share = lambda c: F.log((F.col(c) + SMOOTHING) / ((sums[c] or 0) + SMOOTHING * (sums.v or 1)))
    model = by_word.select("word", (share("b") - share("a")).alias("weight"))
    scores = tokens.join(model, "word").groupBy("host", "path_words").agg((F.sum("weight") + prior).alias("log_odds"))
    scores = staged(scores, "url-scores")
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = rows.drop("html").join(scores, ["host", "path_words"], "left")
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "log_odds")
