"""Jaccard join of documents on five-word shingles by a MinHash LSH forest, with exact verification.

1. Each document gets the key of its text and its MinHash signature: TREES runs of DEPTH values. Equal texts are one class; the row of the
   least doc_id stands for it.
2. A tree is the trie of its runs; a node is a prefix, its members the classes that share it. Entries whose shortest allowed prefix is
   shared are cut out of all trees by one shuffle, and from full depth up prefixes are shortened level by level. In each node that joins
   more than one deeper node, members are compared with leaders: a member whose signature differs from a leader's in at most CAPTURE of
   its values is captured, is compared no more and leaves the tries, so a group of near copies shrinks to few leaders where its prefix is
   longest. Members within EDGE are joined by an edge (a spanning forest for each node). By the triangle inequality, two members of a node
   that differ in at most EDGE - CAPTURE meet through a leader. Shortening ends when a pair as unlike as the least like one found so
   far is missed by all trees with a chance of at most 1 - RECALL, at the latest where that holds for a pair at the threshold.
3. Connected classes are candidates, whose whole texts are read again. A component's centre is the set of shingles that most of a sample of
   its members have. With |S| shingles, of a text let a be those of the centre that it lacks, b those that it has beside it, and D both.
   For a threshold p / q two texts are linked exactly if (q - p) |centre| + (p + q) |D1 and D2 shared| >= cost1 + cost2, where cost is
   q a + p b. Pairs for which this holds without any shared D are counted by a cumulated histogram of costs, so near copies of one
   text cost time in proportion to their number; only texts whose cost leaves a pair open are compared, block against block, and there
   only by their D. Any centre gives the same links; a poor one leaves more pairs open.
4. Components of true links are the near-duplicate classes.

Words are runs of letters and digits in lower case; a text of one to four words is one shingle; texts without words are like one
another only if equal. Defined results: null text is empty; equal texts are one class, however many copies; links are counted between
different texts; repeated rows each keep a row; null doc_ids stand for a class only if all its doc_ids are null, and then the class id is
null; an empty table gives an empty table; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, rows_by_key, staged, text_of
from fieldloom.llm.token_ids import forget_encoders

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.998
#: Members of a node, or of a component's open rest, that one task compares at a time, about.
BLOCK = 256
#: Bytes of hashes that a block holds, about.
BLOCK_BYTES = 16 << 20
#: Shares of a signature's values in which two may differ: to be joined as candidates, and to be captured by a leader. A pair at a similarity
#: of 0.8 differs in EDGE - CAPTURE or more about once in a million.
EDGE, CAPTURE = 0.45, 0.1
#: Members of a component that vote for its centre, about.
VOTERS = 64
_WORD = re.compile(r"[^\W_]+")
_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def key_of(text: Column) -> Column:
    """``text_key`` as a column."""
    return F.unhex(F.md5(text))


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(words) - k + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        mixed = (mixed ^ hashes[j : j + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of TREES * DEPTH permutations: the upper halves of multiples of the hashes."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        values = (hashes[None, at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1).astype(np.uint32))
    return least


def depth_for(recall: float, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """Prefixes are shortened from full depth until a pair at the threshold meets in some tree with this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, signature (the low bytes of all values, then their second bytes; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            keys, signatures = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text)
                keys.append(text_key(text))
                signatures.append(signature(hashes).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "key", "signature"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, key binary, signature binary")


class Forest:
    """Sets of members that are connected."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b


def led(values: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """Pairs (leader, member, share of equal values, captured) of members in order: the first that no leader has captured leads next.
    Only pairs that connect or capture."""
    n = len(values)
    sets, open_, out = Forest(n), np.ones(n, dtype=bool), []
    for i in range(n):
        if not open_[i]:
            continue
        open_[i] = False
        agree = (values == values[i]).mean(axis=1)
        for j in np.flatnonzero(agree >= 1 - EDGE).tolist():
            if j == i:
                continue
            captured = bool(j > i and open_[j] and agree[j] >= 1 - CAPTURE)
            open_[j] &= not captured
            if sets.join(i, j) or captured:
                out.append((i, j, float(agree[j]), captured))
    return out


def met_across(values: np.ndarray, may: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """As ``led``, of every pair that these two blocks decide, without capture."""
    agree = np.stack([(values == v).mean(axis=1, dtype=np.float32) for v in values])
    return [(i, j, float(agree[i, j]), False) for i, j in connecting(agree >= 1 - EDGE, may)]


def blocked(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Rows of (``group``, ``key``, blocks, ...) once for each pair of blocks that they are in: first and second block of the pair, and own."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    return rows.drop("blocks", "other").repartition(*group, "first", "second").sortWithinPartitions(*group, "first", "second", key)


def meeting(own: np.ndarray, first: int, second: int) -> np.ndarray:
    """Which pairs of rows this pair of blocks decides: within one block, or between the two."""
    upper = np.triu(np.ones((len(own), len(own)), dtype=bool), 1)
    return upper if first == second else upper & (own[:, None] != own[None, :])


def connecting(near: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """Of near pairs that this pair of blocks decides, those that connect what is not connected by other pairs within its blocks, which
    other tasks decide: so two blocks of one large group give an edge or two, not one per row."""
    sets = Forest(len(near))
    for i, j in np.argwhere(np.triu(near & ~may, 1)).tolist():
        sets.join(i, j)
    return [(i, j) for i, j in np.argwhere(near & may).tolist() if sets.join(i, j)]


def trie_entries(classes: DataFrame, floor: int) -> DataFrame:
    """tree, id, p<depth> for each depth from ``floor``, and values (a byte of each): an entry for each tree in which a class shares its
    prefix of the least depth."""

    def prefix(tree, depth: int):
        part = lambda half: F.substring("signature", tree * DEPTH + (half * TREES * DEPTH + 1), F.lit(depth))
        return F.xxhash64(tree, part(0), part(1))

    some = classes.filter(F.length("signature") > 0)
    every = some.select("id", F.posexplode(F.array(*[prefix(F.lit(t), floor) for t in range(TREES)])).alias("tree", "prefix"))
    shared = every.groupBy("prefix").agg(F.count("*").alias("size")).filter("size > 1").select("prefix")
    met = staged(every.join(shared, "prefix").select("id", "tree"), "met-prefixes")
    deeper = [prefix(F.col("tree"), d).alias(f"p{d}") for d in range(floor, DEPTH + 1)]
    entries = met.join(some.select("id", "signature"), "id").select("tree", "id", *deeper, F.substring("signature", 1, TREES * DEPTH).alias("values"))
    entries = staged(entries, "trie-entries")
    discard(met)
    return entries


def nodes_at(entries: DataFrame, depth: int) -> DataFrame:
    """node, size, parts: the nodes at this depth; ``parts`` if they join more than one deeper node."""
    deeper = f"p{depth + 1}" if depth < DEPTH else "id"
    return entries.groupBy(F.col(f"p{depth}").alias("node")).agg(F.count("*").alias("size"), (F.min(deeper) != F.max(deeper)).alias("parts"))


def compared(entries: DataFrame, depth: int, nodes: DataFrame, across: bool) -> DataFrame:
    """u, v, agree, captured: the pairs that the members of ``nodes`` give. In a node larger than a block each block compares its own
    members; with ``across``, block meets block."""
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = entries.select(F.col(f"p{depth}").alias("node"), "id", "values").join(nodes.select("node", blocks.alias("blocks")), "node")
    if across:
        rows = blocked(rows, ["node"], "id")
    else:
        rows = rows.withColumn("first", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").withColumn("second", F.col("first"))
        rows = rows.repartition("node", "first").sortWithinPartitions("node", "first", "second", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows_by_key(batches, ["node", "first", "second"]):
            if group.num_rows < 2:
                continue
            ids = group["id"].to_pylist()
            values = np.frombuffer(b"".join(group["values"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            found = met_across(values, meeting(group["own"].to_numpy(), group["first"][0].as_py(), group["second"][0].as_py())) if across else led(values)
            if found:
                u, v, agree, captured = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in u], pa.int64()), pa.array([ids[j] for j in v], pa.int64()), pa.array(agree, pa.float64()), pa.array(captured, pa.bool_())], ["u", "v", "agree", "captured"])

    return rows.mapInArrow(run, "u long, v long, agree double, captured boolean")


def led_away(entries: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries without the captured, in place of those given, and the edges (u, v) of the pairs, in which leaders stand for the captured.

    Only a leader that no one has captured takes others away; so nobody is further than CAPTURE from one who stays."""
    captures = pairs.filter("captured")
    roots = captures.join(captures.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
    gone = staged(roots.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("leader")), "captured")
    left = staged(entries.join(gone.select("id"), "id", "left_anti"), "trie-entries")
    edges = pairs.select("u", "v").distinct()
    for end in "uv":
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("leader", end)).drop("leader")
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    edges = staged(edges.unionByName(gone.select(F.col("leader").alias("u"), F.col("id").alias("v"))), "level-edges")
    discard(entries, gone)
    return left, edges


def level(entries: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, list[DataFrame], float]:
    """The entries that stay, in place of those given, the edges found at this depth, and the least similarity about or above the threshold
    that two signatures have shown. Nodes larger than a block are compared again with their leaders alone until they fit into one, or, where
    fewer than half are captured, block against block: either way all members meet."""
    nodes, found, least = staged(nodes_at(entries, depth).filter("parts"), "nodes"), [], 1.0
    across = False
    while True:
        pairs = staged(compared(entries, depth, nodes, across), "pairs")
        like = pairs.filter(F.col("agree") >= threshold - 0.05).agg(F.min("agree")).first()[0]
        least = min(least, max(threshold, like or 1.0))
        entries, edges = led_away(entries, pairs)
        found.append(edges)
        discard(pairs)
        big = nodes.filter(F.col("size") > BLOCK)
        before = 0 if across else big.agg(F.sum("size")).first()[0]
        if not before:
            discard(nodes)
            return entries, found, least
        smaller = staged(nodes_at(entries, depth).join(big.select("node"), "node", "left_semi"), "nodes")
        discard(nodes)
        nodes = smaller
        across = 2 * (nodes.agg(F.sum("size")).first()[0] or 0) > before


def missed(similarity: float, depth: int) -> float:
    """The chance that two texts of this similarity share no prefix of this depth."""
    return (1 - similarity**depth) ** TREES


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges (u, v) of ids that connect candidates, from id and signature of each class."""
    floor = depth_for(recall, threshold)
    entries = trie_entries(classes, floor)
    found: list[DataFrame] = []
    least = 1.0
    for depth in range(DEPTH, floor - 1, -1):
        entries, edges, like = level(entries, depth, threshold)
        found += edges
        least = min(least, like)
        if least < 1.0 and missed(least, depth) <= 1 - recall:
            break
    edges = staged(reduce(DataFrame.unionByName, found).distinct(), "candidate-edges")
    discard(entries, *found)
    return edges


def components(edges: DataFrame, name: str) -> DataFrame:
    """key, component (its least key) of every end of edges (u, v). Least labels spread along edges and then along labels, so that
    paths halve each round; each round is written."""
    both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    held = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("key"), F.least("u", "v").alias("component")), f"{name}-labels")
    labels = held
    while True:
        offered = both.join(labels.withColumnRenamed("key", "v"), "v").groupBy("u").agg(F.min("component").alias("offer"))
        spread = labels.join(offered.withColumnRenamed("u", "key"), "key").select("key", "component", F.least("component", "offer").alias("to"))
        spread = staged(spread, f"{name}-spread")
        jump = spread.select(F.col("key").alias("to"), F.col("to").alias("further"))
        moved = spread.join(jump, "to", "left").select("key", "component", F.least("to", "further").alias("to"))
        moved = staged(moved, f"{name}-moved")
        discard(held, spread)
        held = moved
        labels = moved.select("key", F.col("to").alias("component"))
        if moved.filter("component <> to").isEmpty():
            discard(both)
            return labels


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share, by products of membership matrices over slices of all hashes that occur in two sets or more."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[column]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((n, n), dtype=np.float64)
    width = 8192
    for begin in range(0, len(shared), width):
        lo, hi = np.searchsorted(at, [begin, begin + width])
        held = np.zeros((n, width), dtype=np.float32)
        held[owner[lo:hi], at[lo:hi] - begin] = 1
        out += held @ held.T
    return out


def own_texts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """text, key, component and size of each candidate, from rows with both its doc_id and its text.

    The candidates grow with the table: they are merged, never broadcast, at whatever size."""
    named = docs.select("doc_id", text_of().alias("text")).withColumn("_own", key_of(F.col("text")))
    wanted = candidates.withColumnRenamed("doc_id", "_doc_id").hint("merge")
    return named.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_own") == F.col("key"))).select("text", "key", "component", "size")


def centres(members: DataFrame) -> DataFrame:
    """component, centre: the hashes that more than half of about VOTERS members have."""
    voters = members.filter(F.pmod(F.xxhash64("key"), F.col("size")) < VOTERS).select("component", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows_by_key(batches, ["component"]):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["hashes"].to_pylist()]
            values, often = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([group["component"].combine_chunks()[:1], pa.array([values[2 * often > len(sets)].tobytes()], pa.binary())], ["component", "centre"])

    return voters.repartition("component").sortWithinPartitions("component").mapInArrow(run, "component long, centre binary")


def measured(members: DataFrame, threshold: float) -> DataFrame:
    """component, key, cost, room ((q - p) times the centre's size) and differs: the hashes in either the text or the centre."""
    share = Fraction(threshold).limit_denominator(1000)
    p, q = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, rooms, differs = [], [], []
            for own, centre in zip(batch.column(2), batch.column(3), strict=True):
                mine = np.frombuffer(own.as_buffer(), dtype=np.uint64)
                # A component none of whose members voted has no centre: all its hashes are beside it.
                middle = np.frombuffer(centre.as_buffer(), dtype=np.uint64) if centre.is_valid else mine[:0]
                beside = np.setdiff1d(mine, middle, assume_unique=True)
                lacks = np.setdiff1d(middle, mine, assume_unique=True)
                costs.append(q * len(lacks) + p * len(beside))
                rooms.append((q - p) * len(middle))
                differs.append(np.concatenate([lacks, beside]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(rooms, pa.int64()), pa.array(differs, pa.binary())], ["component", "key", "cost", "room", "differs"])

    rows = members.join(centres(members), "component", "left").select("component", "key", "hashes", "centre")
    return rows.mapInArrow(run, "component long, key binary, cost long, room long, differs binary")


def sure_links(texts: DataFrame) -> DataFrame:
    """key, links: how many other texts of its component each text is linked to whatever they share beside the centre."""
    by_cost = texts.groupBy("component", "cost", "room").agg(F.count("*").alias("n"))
    points = by_cost.select("component", F.col("cost").alias("at"), "n", F.lit(0).alias("asks")).unionByName(by_cost.select("component", (F.col("room") - F.col("cost")).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asks")))
    upto = F.sum("n").over(Window.partitionBy("component").orderBy("at", "asks"))
    counts = points.select("component", "at", "asks", upto.alias("within")).filter("asks = 1").select("component", (F.col("at")).alias("left"), "within").distinct()
    rows = texts.withColumn("left", F.col("room") - F.col("cost")).join(counts, ["component", "left"])
    return rows.select("key", (F.col("within") - (F.col("cost") <= F.col("left")).cast("long")).alias("links"))


def verified(docs: DataFrame, candidates: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """n_links per key, and the edges (u, v) that connect, of all pairs of candidates at or above the threshold.

    ``candidates`` has key, doc_id (whose text it is), component and size."""
    share = Fraction(threshold).limit_denominator(1000)
    both = share.numerator + share.denominator

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(hashes, pa.binary())], ["key", "component", "size", "hashes"])

    # Repeated rows repeat a member, which then votes twice and is measured twice; from then on it stands once.
    members = staged(own_texts(docs, candidates).mapInArrow(texts, "key binary, component long, size long, hashes binary"), "members")
    known = staged(measured(members, threshold).dropDuplicates(["key"]), "measured")
    discard(members)
    ends = known.groupBy("component").agg(F.max("cost").alias("most"), F.min(F.struct("cost", "key")).alias("anchor"))
    ranged = known.join(ends, "component")
    sure = ranged.filter((F.col("cost") + F.col("anchor.cost") <= F.col("room")) & (F.col("key") != F.col("anchor.key"))).select(F.col("anchor.key").alias("u"), F.col("key").alias("v"))
    rest = staged(ranged.filter(F.col("cost") + F.col("most") > F.col("room")).select("component", "key", "cost", "room", "differs"), "open-texts")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("differs")) / BLOCK_BYTES))
    sizes = rest.groupBy("component").agg(F.count("*").alias("size"), parts.alias("blocks")).filter("size > 1").drop("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows_by_key(batches, ["component", "first", "second"]):
            keys = group["key"].to_pylist()
            may = meeting(group["own"].to_numpy(), group["first"][0].as_py(), group["second"][0].as_py())
            cost = group["cost"].to_numpy()
            short = cost[:, None] + cost[None, :] - group["room"][0].as_py()
            shared = shared_counts([np.frombuffer(x, dtype=np.uint64) for x in group["differs"].to_pylist()])
            near = (short > 0) & (both * shared >= short)
            links = (near & may).sum(axis=0) + (near & may).sum(axis=1)
            edges = connecting(near, may)
            k = [keys[i] for i in np.flatnonzero(links)]
            yield pa.RecordBatch.from_arrays([pa.array(k + [keys[i] for i, _ in edges], pa.binary()), pa.array([None] * len(k) + [keys[j] for _, j in edges], pa.binary()), pa.array(links[links > 0].tolist() + [0] * len(edges), pa.int64())], ["u", "v", "links"])

    found = staged(blocked(rest.join(sizes, "component"), ["component"], "key").mapInArrow(run, "u binary, v binary, links long"), "open-links")
    counted = sure_links(known).unionByName(found.filter("v is null").select(F.col("u").alias("key"), "links"))
    links = staged(counted.groupBy("key").agg(F.sum("links").alias("n_links")), "links")
    edges = staged(sure.unionByName(found.filter("v is not null").select("u", "v")).distinct(), "true-edges")
    discard(known, rest, found)
    return links, edges


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """doc_id and key of each row; and for each key text_id, copies, class_id, n_links and class_key: the text that stands for the class,
    which is that of the least doc_id, null last, and then the least key."""
    signatures = staged(signed(docs), "signatures")
    rows = signatures.select("doc_id", "key")
    of_text = [F.min("doc_id").alias("text_id"), F.count("*").alias("copies"), F.min("signature").alias("signature")]
    equal = staged(signatures.groupBy("key").agg(*of_text).withColumn("id", F.xxhash64("key")), "equal-texts")
    met = candidate_edges(equal.select("id", "signature"), threshold, recall)
    joined = components(met, "candidates").withColumnRenamed("key", "id")
    # Should two texts have one id, both are candidates; what they share is told by their texts.
    named = joined.join(equal.select("id", "key", F.col("text_id").alias("doc_id")), "id").select("key", "doc_id", "component")
    candidates = staged(named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component"), "candidates")
    links, edges = verified(docs, candidates, threshold)
    groups = components(edges, "linked")
    named = groups.join(equal.select("key", "text_id"), "key")
    first = F.min(F.struct(F.col("text_id").isNull(), "text_id", "key"))["key"]
    least = named.groupBy("component").agg(F.min("text_id").alias("class_id"), first.alias("class_key"))
    found = staged(groups.join(least, "component").join(links, "key", "left").select("key", "class_id", "class_key", "n_links"), "groups")
    of_class = [F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links")]
    known = staged(equal.drop("signature").join(found, "key", "left").select("key", "text_id", "copies", *of_class), "text-classes")
    discard(equal, met, candidates, links, edges, found)
    return rows, known


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the near-duplicate class), text_id (least doc_id of the equal texts), n_links (different texts at or
    above the threshold), copies (rows of this text)."""
    rows, known = text_classes(docs, threshold, recall)
    return rows.join(known, "key").select("doc_id", "class_id", "text_id", "n_links", "copies")
