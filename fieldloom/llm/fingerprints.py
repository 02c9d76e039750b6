"""Threshold-scaled sketches of documents, in DataFrame functions only.

A sketch holds every hash of a five-word shingle that lies below a fixed fraction of the hash range, and of a text of at most SHORT
shingles also those above it. Below the fraction the same hashes are kept everywhere, so the sketches of a text's parts, cut there, merge
by union, and the share of the smaller sketch that the larger one holds estimates containment between texts of very unequal length.
Two sketches are compared in full where both hold hashes above the fraction, so texts of few shingles exactly, else only below it.

Words are runs of letters and digits in lower case; a text of one to four words is one shingle. Defined results: null text is empty;
an empty text has an empty sketch, which is like (1.0) another empty one and unlike (0.0) any other; where the
smaller text has no hash in the range compared, nothing is known: ``likeness`` is null and ``edited_fingerprints`` gives 0.0; repeated rows have equal fingerprints; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import let, text_of

SHINGLE = 5
FRACTION = 1 / 2
#: Texts of so many distinct shingles at most keep all their hashes.
SHORT = 150
LEAST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, k: int = SHINGLE) -> Column:
    """From the array of word hashes."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def limit(fraction: float) -> Column:
    return F.lit(LEAST + int(fraction * (1 << 64)))


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    def kept(all_: Column) -> Column:
        return F.sort_array(F.when(F.size(all_) <= SHORT, all_).otherwise(F.filter(all_, lambda h: h < limit(fraction))))

    return let(word_hashes(text), lambda h: let(F.array_distinct(shingles(h)), kept))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated containment of the smaller in the larger: 0 to 1; null where the smaller has no hash in the range that both keep."""
    whole = (F.array_max(a) >= limit(fraction)) & (F.array_max(b) >= limit(fraction))
    low = lambda x: F.filter(x, lambda h: h < limit(fraction))

    def share(s: Column) -> Column:
        least = F.least(F.size(s["a"]), F.size(s["b"]))
        return F.when(least > 0, F.size(F.array_intersect(s["a"], s["b"])) / least).cast("double")

    compared = let(F.when(whole, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(low(a).alias("a"), low(b).alias("b"))), share)
    empty = F.least(F.size(a), F.size(b)) == 0
    return F.when(empty, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(compared)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of two texts together, from their sketches.

    A sketch without a hash above the fraction is of a text that is not short, unless it is so small that such a text would have more."""
    complete = lambda x: (F.size(x) < int(SHORT * fraction / 2)) | (F.array_max(x) >= limit(fraction))
    both = complete(a) & complete(b)
    kept = lambda w: F.sort_array(F.when(both & (F.size(w) <= SHORT), w).otherwise(F.filter(w, lambda h: h < limit(fraction))))
    return let(F.array_union(a, b), kept)


def fingerprint(sketched: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, in order, joined by commas."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def _block(key: Column, bounds: list[float]) -> Column:
    """How many of the descending bounds are above the key, by binary search."""
    held = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    ahead = lambda at, s: F.when(F.get(held, at + s - F.lit(1)) > key.cast("double"), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), ahead)


def with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the document next in descending doc_id; the last's next is the first.

    Blocks of the doc_id range, as many as shuffle partitions, are ordered each for itself. Each block also gets a copy of the
    next block's first row, so the order has no gap between blocks. Rows of equal doc_id are ordered by text; null doc_ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_key", F.coalesce("doc_id", F.lit(LEAST)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.stat.approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    rows = rows.withColumn("_block", _block(F.col("_key"), sorted(set(cuts), reverse=True))).withColumn("_copy", F.lit(False))
    # One row per block, so at most as many as shuffle partitions: in one task, and then broadcast.
    firsts = rows.groupBy("_block").agg(F.max("_key").alias("_key"))
    order = Window.orderBy("_block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = firsts.select("_key", F.coalesce(F.lag("_block").over(order), F.last("_block").over(whole)).alias("_block"))
    copies = rows.drop("_block").join(F.broadcast(chain), "_key").withColumn("_copy", F.lit(True))
    both = rows.unionByName(copies).withColumn("sketch", sketch(F.col("text"), fraction))
    along = Window.partitionBy("_block").orderBy("_copy", F.col("_key").desc(), "text")
    led = both.withColumn("next_text", F.lead("text").over(along)).withColumn("next_sketch", F.lead("sketch").over(along))
    return led.filter(~F.col("_copy")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced by the next document's beginning, and how like
    its own the edited text's and the next document's are."""
    rows = with_next(docs, fraction).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), fraction))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.coalesce(likeness(F.col("sketch"), F.col("edited_sketch"), fraction), F.lit(0.0)).alias("near_edited"),
        F.coalesce(likeness(F.col("sketch"), F.col("next_sketch"), fraction), F.lit(0.0)).alias("near_next"),
    )
