"""Toxic passages as maximal-scoring segments of token log-odds.

``fit`` learns from a bounded, hash-chosen sample of labelled rows: each token's log-odds between toxic and clean rows under an
informative Dirichlet prior (each token's prior count is a share of its count in all rows; a row counts a token once). Tokens with a clear and large effect score
their log-odds, all others the small negative log-odds of not being one of them. A linear scan finds every maximal segment of a
document. A segment of score s in a document of n tokens is expected K n exp(-s) times by chance (extreme-value statistics; the
scores are log-odds, so their scale is 1); K is set on clean rows. A document's evidence is the sum of -ln(expectation) over its
significant segments, and a logistic curve fitted on the same rows makes of it a probability.

Defined results: null and empty texts have no evidence and get the lowest score; repeated rows get equal scores and teach once; null labels teach
nothing; doc_ids with several labels count as toxic if any says so; without labelled rows of both kinds every score is 0; an empty
table gives an empty table; whole texts are read, however long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import discard, staged, text_of
from fieldloom.llm.token_ids import forget_encoders

#: Labelled rows, at most, that teach the model; what is broadcast and collected is bounded by it.
MAX_LABELLED = 20_000
PRIOR_SHARE = 0.02
#: Chance that any token without effect is learnt, about.
LEVEL = 0.01
LEAST_LOG_ODDS = 1.0
SIGNIFICANT = 0.05
_TOKEN = regex.compile(r"\p{L}+")
_BREAK = regex.compile(r"\P{L}")


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.01
    k: float = 1.0
    bias: float = -math.inf
    slope: float = 0.0


def segments(items: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, begin, end) of runs (score, begin, end), in linear time.

    A stack holds candidates with the running totals before and after them. A new positive run joins back with the last candidate
    that began at a lower total as long as that one ended no higher than the new one ends.
    """
    total, stack = 0.0, []
    for score, begin, end in items:
        before, total = total, total + score
        if score <= 0:
            continue
        low, high, begin_at = before, total, begin
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= high:
                break
            low, begin_at = stack[k][0], stack[k][2]
            del stack[k:]
        k = len(stack) - 1
        while k >= 0 and stack[k][0] >= low:
            k = stack[k][4]
        stack.append((low, high, begin_at, end, k))
    return [(high - low, begin, end) for low, high, begin, end, _ in stack]


def token_runs(text: str, chars: int = 100_000) -> Iterator[list[str]]:
    """The tokens of a text, in lists of about so many characters, each ending where a token does."""
    at = 0
    while at < len(text):
        border = _BREAK.search(text, at + chars)
        end = border.start() if border else len(text)
        yield _TOKEN.findall(text, at, end)
        at = end


def passages(text: str, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of tokens, and the maximal segments in token places."""
    items, at, n, terms = [], 0, 0, model.terms
    for tokens in token_runs(text.lower()):
        for i, score in [(i, terms[t]) for i, t in enumerate(tokens, n) if t in terms]:
            if i > at:
                items.append((model.neutral * (i - at), at, i))
            items.append((score, i, i + 1))
            at = i + 1
        n += len(tokens)
    return n, segments(items)


def evidence(text: str, model: Model) -> tuple[float, list[tuple[float, int, int]]]:
    """The document's evidence and its significant segments."""
    n, found = passages(text, model)
    total, kept = 0.0, []
    for score, begin, end in found:
        log_expected = math.log(model.k * n) - score
        if log_expected < math.log(SIGNIFICANT):
            total -= log_expected
            kept.append((score, begin, end))
    return total, kept


def probability(total: float, model: Model) -> float:
    if model.bias == -math.inf:
        return 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, model.bias + model.slope * math.log1p(total)))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a slight ridge, which also holds where x separates y."""
    rows = np.stack([np.ones_like(x), x], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-6, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + ridge, rows.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """``labels`` has doc_id and toxic; hold rows out before calling."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # A doc_id may stand at many rows: repeated ones count once, and the rows, by digests of their texts, are bounded too.
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("key", F.md5("text"))
    texts = staged(texts.dropDuplicates(["doc_id", "key"]), "labelled-texts")
    taken = texts.select("doc_id", "key").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(max_labelled)
    rows = staged(texts.join(F.broadcast(taken), ["doc_id", "key"]).select("text", "toxic"), "labelled")
    discard(texts)
    tokens = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("token"), "toxic").filter("token <> ''")
    by_token = tokens.groupBy("token").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    sums = by_token.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.count("*").alias("v")).first()
    if not sums.n1 or not sums.n0:
        return Model()
    n1, n0 = float(sums.n1), float(sums.n0)
    prior = PRIOR_SHARE * (n1 + n0)
    a = PRIOR_SHARE * (F.col("y1") + F.col("y0"))
    odds = lambda y, n: F.log((F.col(y) + a) / (n + prior - F.col(y) - a))
    effect = by_token.withColumn("delta", odds("y1", n1) - odds("y0", n0))
    # Likelihood ratio against equal rates, at a level for all tokens together: one row's odd words are not learnt.
    excess = lambda y, n: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) * (n1 + n0) / ((F.col("y1") + F.col("y0")) * n))).otherwise(0.0)
    effect = effect.withColumn("ratio", 2 * (excess("y1", n1) + excess("y0", n0)))
    terms = effect.filter((F.col("ratio") >= 2 * math.log(sums.v / LEVEL)) & (F.col("delta") >= LEAST_LOG_ODDS)).collect()  # a term takes several labelled rows: bounded as they are
    model = Model()
    if terms:
        model.terms = {r.token: float(r.delta) for r in terms}
        share = lambda y, n: min(0.5, (sum(float(r[y]) for r in terms) + 0.5) / (n + 1))
        model.neutral = min(-1e-4, math.log((1 - share("y1", n1)) / (1 - share("y0", n0))))
    # K: how often clean rows reach the least score of a term, against their length.
    rows = rows.select("text", F.col("toxic").cast("double").alias("toxic"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            found = [passages(t.as_py(), model) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64())], ["toxic", "n", "hits"])

    clean = rows.mapInArrow(scan, "toxic double, n long, hits long").filter("toxic = 0").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    model.k = math.exp(min(model.terms.values(), default=0.0)) * ((clean.hits or 0) + 0.5) / max(1, clean.n or 0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([evidence(t.as_py(), model)[0] for t in batch.column(0)], pa.float64())], ["toxic", "total"])

    pairs = rows.mapInArrow(weigh, "toxic double, total double").collect()  # at most max_labelled
    model.bias, model.slope = _logistic(np.log1p([r.total for r in pairs]), np.array([r.toxic for r in pairs]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with score and the significant segments: their scores and token places."""
    names = ["row", "score", "segments"]
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    out = T.StructType([rows.schema["row"], *T.StructType.fromDDL("score double, segments array<struct<score: double, begin: int, end: int>>").fields])
    part = pa.list_(pa.struct([("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            found = [evidence(t.as_py(), model) for t in batch.column(1)]
            scores = pa.array([probability(total, model) for total, _ in found], pa.float64())
            spans = pa.array([[{"score": s, "begin": b, "end": e} for s, b, e in kept] for _, kept in found], part)
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, spans], names)

    return rows.mapInArrow(run, out)
