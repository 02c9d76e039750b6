"""Known places as a table, found in texts with up to one letter lost, added or changed.

Runs of words meet places by deletion keys: a text and each way of leaving one letter out. Two texts one edit apart share a key, so an equi-join
finds all candidates, and the exact distance decides. Each distinct run of the corpus is looked up once, however many documents hold it; where
the keys of all places are few bytes, they are broadcast instead and no run is shuffled.

Of a document's matches the one beside a label wins, then the one with most words, the fewest edits, the first place in the text, the least name.

Defined results: null texts are empty; a text without a place gives no row; null and blank places are none; repeated places and documents change
nothing; names shorter than ``least`` letters are only found as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import with_computed

#: Most bytes of keys that are broadcast.
BROADCAST_BYTES = 8 << 20
#: Words before a run in which a label counts, and words behind it.
LABEL_BEFORE, LABEL_AFTER = 3, 1


def folded(text: Column) -> Column:
    """Lower case without marks over letters, Arabic letters in one spelling, words parted by one space."""
    plain = F.translate(F.lower(text), "àâäéèêëîïôöùûüç" + "أإآىة", "aaaeeeeiioouuuc" + "اااي" + "ه")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def union_places(*tables: DataFrame) -> DataFrame:
    """place, of all tables' ``place``: each folded form once, in the spelling that comes first by order."""
    rows = reduce(DataFrame.unionByName, [t.select("place") for t in tables])
    rows = with_computed(rows, form=folded(F.col("place"))).filter("form is not null and form <> ''")
    return rows.groupBy("form").agg(F.min("place").alias("place")).select("place", "form")


def keys(text: Column, least: int) -> Column:
    """A text and, from ``least`` letters on, all it becomes when one letter is left out."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), F.when(n >= least, cut).otherwise(F.array().cast("array<string>"))))


def runs(doc: DataFrame, most: int, labels: list[str], text: str) -> DataFrame:
    """doc_id, run, size, at, labelled: runs of up to ``most`` words."""
    rows = with_computed(doc.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")), words=F.filter(F.split(folded(F.col("t")), " "), lambda w: w != ""))
    marks = F.array(*map(F.lit, labels)).cast("array<string>")
    start = lambda i: F.greatest(i - LABEL_BEFORE, F.lit(0)) + 1
    near = lambda i, k: F.arrays_overlap(F.slice("words", start(i), i - start(i) + 1), marks) | F.arrays_overlap(F.slice("words", i + k + 1, F.lit(LABEL_AFTER)), marks)
    one = lambda k: F.transform("words", lambda w, i: F.when(i + k <= F.size("words"), F.struct(F.array_join(F.slice("words", i + 1, F.lit(k)), " ").alias("run"), F.lit(k).alias("size"), i.alias("at"), F.coalesce(near(i, k), F.lit(False)).alias("labelled"))))
    found = F.array_compact(F.concat(*(one(k) for k in range(1, most + 1))))
    return rows.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.*")


def matched(run: DataFrame, places: DataFrame, least: int = 5, small: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``run`` with each place that is at most one edit from it: place, edits."""
    known = places.select("place", "form", F.explode(keys(F.col("form"), least)).alias("key"))
    size = places.agg(F.sum((F.length("form") + 1) * (F.octet_length("form") * 2 + F.octet_length("place")))).first()[0] or 0
    distance = F.levenshtein("run", "form", 1)
    close = (F.col("run") == F.col("form")) | ((distance == 1) & (F.length("form") >= least) & (F.length("run") >= least - 1))
    edits = F.when(F.col("run") == F.col("form"), 0).otherwise(1).alias("edits")

    def pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
        asked = rows.withColumn("key", F.explode(keys(F.col("run"), least - 1)))
        return asked.join(known, "key").filter(close).select(*rows.columns, "place", edits).distinct()

    if size <= small:
        return pairs(run, F.broadcast(known))
    # Spark's estimates don't see that a place becomes many keys, and would broadcast all by the bytes of the places' table.
    return run.join(pairs(run.select("run").distinct(), known.hint("merge")).hint("merge"), "run")


def place_lookup(doc: DataFrame, places: DataFrame, labels: list[str] | None = None, text: str = "raw_text", least: int = 5, small: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, place, edits, labelled: the place that each text names, of a table with ``place``."""
    table = union_places(places)
    most = table.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    found = matched(runs(doc, most, [*(labels or [])], text), table, least, small)
    order = F.struct((~F.col("labelled")).alias("l"), -F.col("size"), "edits", "at", "place")
    best = found.groupBy("doc_id").agg(F.min_by(F.struct("place", "edits", "labelled"), order).alias("b"))
    return best.select("doc_id", "b.*")
