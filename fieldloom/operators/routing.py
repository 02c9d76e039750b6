"""Document types by weighted keywords: literals unrolled into one projection, so no join with the keyword table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_type(doc: DataFrame, keywords: dict[str, dict[str, float]], full_score: float = 4.0) -> DataFrame:
    """doc_id, document_type, score, confidence (score over ``full_score``, at most 1). The first type wins ties; none without a hit."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = []
    for kind, words in keywords.items():
        total = F.lit(0.0)
        for word, weight in words.items():
            total = total + F.when(F.col("_low").contains(word), float(weight)).otherwise(0.0)
        scores.append(F.struct(total.alias("score"), F.lit(-len(scores)).alias("order"), F.lit(kind).alias("kind")))
    best = doc.select("doc_id", low.alias("_low")).select("doc_id", F.array_max(F.array(*scores)).alias("best"))
    found = F.col("best.score") > 0
    return best.select("doc_id", F.when(found, F.col("best.kind")).alias("document_type"), F.col("best.score").alias("score"), F.least(F.col("best.score") / full_score, F.lit(1.0)).alias("confidence"))


# The first signs of a passport's machine-readable zone, and what they are worth to its family.
ZONE_SIGN, ZONE_SCORE = r"p<[a-z]{3}", 0.85


def classify_family(doc: DataFrame, keywords: dict[str, list[str]], floor: float = 0.20, zone_family: str | None = None) -> DataFrame:
    """Share of hits among a family's words, of which five are enough; below the floor unknown. The first family wins ties. A text with the
    first signs of a machine-readable zone is worth 0.85 at least to ``zone_family``."""
    low = doc.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    scores = []
    for kind, words in keywords.items():
        hits = sum((F.col("_low").contains(w).cast("int") for w in words), F.lit(0))
        score = F.least(hits / min(len(words), 5), F.lit(1.0))
        if kind == zone_family:
            score = F.when(F.col("_low").rlike(ZONE_SIGN), F.greatest(score, F.lit(ZONE_SCORE))).otherwise(score)
        scores.append(F.struct(score.alias("score"), F.lit(-len(scores)).alias("order"), F.lit(kind).alias("kind")))
    best = low.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    known = F.col("b.score") >= floor
    return best.select("doc_id", F.when(known, F.col("b.kind")).otherwise("unknown").alias("family"), F.round(F.when(known, F.col("b.score")).otherwise(0.0), 4).alias("confidence"))


def classify_variant(doc: DataFrame, variants: dict[str, tuple[list[str], list[str], float]], generic: str, scripts: dict[str, str] | None = None) -> DataFrame:
    """Variants: name to required words, bonus words, least score. 0.5 where all required are there, 0.4 of the bonus share, and 0.1 where most
    words of three letters or more are in the variant's script (``arabic`` or ``latin``)."""
    low = doc.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    scores = []
    for name, (required, bonus, least) in variants.items():
        all_there = F.lit(True)
        for w in required:
            all_there = all_there & F.col("_low").contains(w.lower())
        share = sum((F.col("_low").contains(w.lower()).cast("int") for w in bonus), F.lit(0)) / max(len(bonus), 1)
        score = 0.5 + 0.4 * share
        if scripts and name in scripts:
            arabic, latin = (F.regexp_count("_low", F.lit(p)) for p in (r"[\x{0600}-\x{06FF}]{3,}", r"[a-zA-ZÀ-ÿ]{3,}"))
            script = F.when(arabic > latin, "arabic").when(latin > 0, "latin")
            score = score + F.when(script == scripts[name], 0.1).otherwise(0.0)
        score = F.round(score, 3)
        scores.append(F.when(all_there & (score >= least), F.struct(score.alias("score"), F.lit(-len(scores)).alias("order"), F.lit(name).alias("name"))))
    best = low.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    return best.select("doc_id", F.coalesce("b.name", F.lit(generic)).alias("variant"), F.coalesce("b.score", F.lit(0.0)).alias("confidence"))


def auto_template(doc: DataFrame, anchors: dict[str, tuple[list[str], list[str]]], least: int = 3) -> DataFrame:
    """Templates: id to anchors (3 each) and field anchors (1 each); none below ``least``. The first template wins ties."""
    low = doc.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    scores = []
    for name, (strong, weak) in anchors.items():
        score = sum((F.when(F.col("_low").contains(w.lower()), k).otherwise(0) for k, words in ((3, strong), (1, weak)) for w in words), F.lit(0))
        scores.append(F.struct(score.alias("score"), F.lit(-len(scores)).alias("order"), F.lit(name).alias("name")))
    best = low.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    return best.select("doc_id", F.when(F.col("b.score") >= least, F.col("b.name")).alias("template_id"), F.col("b.score").cast("bigint").alias("score"))


def route(doc: DataFrame, by_type: dict[str, str]) -> DataFrame:
    """The explicit template, else the type's, else the classifier's, with the method that decided."""
    mapped = F.lit(None).cast("string")
    for kind, template in by_type.items():
        mapped = F.when(F.col("document_type") == kind, template).otherwise(mapped)
    given, guess = F.col("given_template"), F.col("guessed_template")
    method = F.when(given.isNotNull(), "explicit").when(mapped.isNotNull(), "type").when(guess.isNotNull(), "classifier").otherwise("none")
    return doc.select("doc_id", F.coalesce(given, mapped, guess).alias("template_id"), method.alias("method"))


def needs_second_pass(field: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    limit = F.lit(default)
    for name, t in thresholds.items():
        limit = F.when(F.col("name") == name, t).otherwise(limit)
    return field.filter(F.coalesce("confidence", F.lit(0.0)) < limit)
