"""A z-fast trie of conversations: nodes hashed at their two-fattest handles, filled in batches, counted and expanded.

A conversation is a string of turns, and a prefix of d turns is known by a digest that chains the turns' own. The trie is compacted: a node
stands where prefixes branch or a conversation ends, and keeps the digests of the edge above it. It is found by its handle, the digest at
the one depth of its edge that most powers of two divide. A conversation looks for its exit by fat binary search: it asks for the handle at
the two-fattest depth of what is left of its length, goes below the node where there is one and above that depth where not, so a
conversation of L turns asks log L times. Then its exit edge is split, and what is new hangs there.

Distinct conversations go in by batches, in the order of a hash, each ``GROWTH`` times as large as all before. The first has about ``FIRST``
of them whatever the input; in later ones, those that share a first new turn are few: had they been many, one would have come earlier.
So a prefix that a third of all conversations share is in the trie before they come, and no group is large.

Members are summed up to all ancestors by doubling the way that each node looks up, so a chain of n nodes takes log n rounds. Last, edges are
expanded: a node inside an edge has the members of the node at its end.

Defined results: turns are ordered by ``turn`` (null first), then by their digest; null roles and texts are empty; rows without conv_id
belong to no conversation; repeated rows are turns of their own; an empty table gives an empty table, without a root; other columns are
ignored. One conversation's digests (about 40 bytes a turn) fit a row; texts are dropped before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, staged, text_of

#: Distinct conversations in the first batch, about.
FIRST = 4096
#: Each batch has so many times as many as all before.
GROWTH = 16
#: Bytes of a digest.
SIZE = 16
#: Conversation ids that one block of a node's ends spans.
BLOCK = 1024

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = "node binary, depth int, parent binary, parent_depth int, handle binary, first binary, edge binary, totals array<bigint>"


def turn_digest(role: Column, text: Column) -> Column:
    """Of a turn's role and text, which its length keeps apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, SIZE)


def conversations(table: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as digest and code points."""
    role, text = text_of("role"), text_of()
    turn = F.struct("turn", turn_digest(role, text).alias("digest"), F.length(text).alias("chars"))
    rows = table.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(convs: DataFrame, each: int = 100, most: int = 6) -> DataFrame:
    """Each conversation begins with the first h turns of the one whose id is the multiple of ``each`` below, then come its own after its first
    h; h is crc32 of its decimal id modulo ``most``."""
    heads = convs.filter(F.col("conv_id") % each == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rows = convs.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % each).join(heads, "head_id", "left")
    return rows.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """conv_id, key (the digest of the whole), n, path (the digests of all prefixes, one after the other) and totals (code points up to each)."""
    schema = "conv_id long, key binary, n int, path binary, totals array<bigint>"
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digests, chars in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last, path = b"", []
                for digest in digests:
                    last = hashlib.sha256(last + digest).digest()[:SIZE]
                    path.append(last)
                rows.append((last, len(path), b"".join(path), np.cumsum([0, *chars]).tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds[1:])], ["conv_id", "key", "n", "path", "totals"])

    return convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars")).mapInArrow(run, schema)


def digest_at(path: Column, depth: Column) -> Column:
    return F.substring(path, (depth - 1) * SIZE + 1, F.lit(SIZE))


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that most powers of two divide: the bits of high from the highest on in which both differ."""
    bit = F.length(F.bin(low.bitwiseXOR(high).cast("bigint"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bit), bit)


def shared(path: Column, edge: Column, start: Column) -> Column:
    """How many of the edge's digests, which begin behind ``start`` turns, the path has too: digests chain, so they agree up to some depth."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(edge), F.length(path) - start * SIZE).cast("int").bitwiseOR(0) / SIZE).cast("int"))
    same = F.filter(steps, lambda i: (digest_at(edge, i) == digest_at(path, start + i)) & (digest_at(path, start + i) != F.lit(b"")))
    return F.size(same)


def exits(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """The batch with exit_node (the node whose edge, or end, is left; empty: the root) and exit_depth (turns that the trie has)."""
    found: list[DataFrame] = []
    known = nodes.select("handle", F.col("node").alias("hit"), F.col("depth").alias("hit_depth"), F.col("parent_depth").alias("hit_from"), F.col("edge").alias("hit_edge"))
    active = batch.withColumns({"low": F.lit(0), "high": F.col("n"), "at": F.lit(b"")})
    columns, used = active.columns, []
    while True:
        handle = digest_at(F.col("path"), two_fattest(F.col("low"), F.col("high")))
        asked = active.withColumn("handle", handle).join(known, "handle", "left")
        whole = (F.col("hit_depth") <= F.col("n")) & (digest_at(F.col("path"), F.col("hit_depth")) == F.col("hit"))
        below, left = F.col("hit").isNotNull() & whole, F.col("hit").isNotNull() & ~whole
        stepped = asked.select(
            *batch.columns,
            F.when(below, F.col("hit_depth")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("hit").isNull(), two_fattest(F.col("low"), F.col("high")) - 1).otherwise(F.col("high")).alias("high"),
            F.when(F.col("hit").isNotNull(), F.col("hit")).otherwise(F.col("at")).alias("at"),
            F.when(left, F.col("hit_from") + shared(F.col("path"), F.col("hit_edge"), F.col("hit_from"))).alias("exit_depth"),
        )
        step = staged(stepped.withColumn("active", F.col("exit_depth").isNull() & (F.col("low") < F.col("high"))), "trie-search")
        used.append(step)
        found.append(step.filter("not active").drop("active"))
        active = step.filter("active").select(columns)
        if active.isEmpty():
            break
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    # Below the last node found there may be an edge that begins as the conversation goes on, with its handle deeper than both agree.
    edges = nodes.select(F.col("first"), F.col("node").alias("edge_node"), F.col("parent_depth").alias("edge_from"), F.col("edge").alias("edge_edge"))
    onward = F.when(F.col("exit_depth").isNull() & (F.col("low") < F.col("n")), digest_at(F.col("path"), F.col("low") + 1)).otherwise(F.substring(F.unhex(F.md5(F.col("key"))), 1, 8))
    asked = done.withColumn("first", onward).join(edges, "first", "left")
    depth = F.when(F.col("exit_depth").isNotNull(), F.col("exit_depth")).when(F.col("edge_node").isNotNull(), F.col("edge_from") + shared(F.col("path"), F.col("edge_edge"), F.col("edge_from"))).otherwise(F.col("low"))
    out = staged(asked.select(*batch.columns, F.coalesce("edge_node", "at").alias("exit_node"), depth.alias("exit_depth")), "trie-exits")
    discard(*used)
    return out


def build(group: list[tuple[bytes, list[int]]], base: int) -> Iterator[tuple]:
    """Nodes of the compacted trie of distinct paths that agree up to ``base`` turns and one further: paths in order, open nodes on a stack."""

    def node(path: bytes, totals: list[int], low: int, high: int) -> tuple:
        bit = (low ^ high).bit_length() - 1
        fat = high >> bit << bit
        cut = lambda d: path[(d - 1) * SIZE : d * SIZE]
        return cut(high), high, cut(low) if low else b"", low, cut(fat), cut(low + 1), path[low * SIZE : high * SIZE], totals[low : high + 1]

    group = sorted(group)
    stack, before = [base], None
    for path, totals in group:
        if before is not None:
            a, b = np.frombuffer(before[0], "V16"), np.frombuffer(path, "V16")
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            depth = int(differ[0]) if len(differ) else n
            while stack[-1] > depth:
                top = stack.pop()
                if stack[-1] < depth:
                    stack.append(depth)
                yield node(*before, stack[-1], top)
        stack.append(len(path) // SIZE)
        before = (path, totals)
    while len(stack) > 1:
        top = stack.pop()
        yield node(*before, stack[-1], top)


def hung(left: DataFrame) -> DataFrame:
    """New nodes of conversations that leave the trie, by the first digest that it does not have."""
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base, group, made = None, 0, [], []
        for batch in batches:
            for first, depth, path, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first != last:
                    made += build(group, base)
                    last, base, group = first, depth, []
                group.append((path, totals))
            if len(made) > 10_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*made, strict=True), kinds)), names)
                made = []
        made += build(group, base)
        if made:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*made, strict=True), kinds)), names)

    rows = left.filter("exit_depth < n").select(digest_at(F.col("path"), F.col("exit_depth") + 1).alias("first"), "exit_depth", "path", "totals")
    return rows.repartition("first").sortWithinPartitions("first").mapInArrow(run, NODE)


def split(nodes: DataFrame, out: DataFrame) -> DataFrame:
    """Nodes with each edge cut at the depths where conversations leave it."""
    cuts = out.groupBy(F.col("exit_node").alias("node")).agg(F.collect_set("exit_depth").alias("cuts"))
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda d: (d > F.col("parent_depth")) & (d < F.col("depth")))
    ends = F.concat(F.array("parent_depth"), F.sort_array(inside), F.array("depth"))
    rows = nodes.join(cuts, "node", "left").withColumn("ends", ends).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)))
    low, high = F.get("ends", F.col("i") - 1), F.get("ends", F.col("i"))
    start = F.col("parent_depth")
    at = lambda depth: digest_at(F.col("edge"), depth - start)
    return rows.select(
        at(high).alias("node"),
        high.alias("depth"),
        F.when(low == start, F.col("parent")).otherwise(at(low)).alias("parent"),
        low.alias("parent_depth"),
        at(two_fattest(low, high)).alias("handle"),
        at(low + 1).alias("first"),
        F.substring(F.col("edge"), (low - start) * SIZE + 1, (high - low) * SIZE).alias("edge"),
        F.slice("totals", low - start + 1, high - low + 1).alias("totals"),
    )


def build_trie(distinct: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Nodes of the trie of all distinct conversations with a turn; a staged table."""
    ordered = distinct.filter("n > 0").withColumn("rank", (F.xxhash64("key") / F.lit(2.0**64) + 0.5))
    n = ordered.count()
    upper, bounds = min(1.0, first / max(n, 1)), []
    while True:
        bounds.append(upper)
        if upper >= 1:
            break
        upper = min(1.0, upper * (growth + 1))
    nodes, low = None, -1.0
    for high in bounds:
        batch = ordered.filter((F.col("rank") >= low) & ((F.col("rank") < high) | F.lit(high >= 1))).drop("rank")
        if nodes is None:
            nodes = staged(hung(batch.withColumn("exit_depth", F.lit(0))), "trie-nodes")
        else:
            out = exits(batch, nodes)
            grown = staged(split(nodes, out).unionByName(hung(out)), "trie-nodes")
            discard(nodes, out)
            nodes = grown
        low = high
    return nodes


def ends_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256, of the ids of all conversations with this key, in order. Ids of a block are joined where they meet; the digest then
    reads blocks, one batch at a time."""
    block = F.floor(F.col("conv_id") / BLOCK)
    blocks = members.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or key != last:
                    if sha:
                        done.append((last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return blocks.select("key", "block", text.alias("ids")).repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


SUMS = {"n": F.sum, "least": F.min, "leaves": F.sum, "weighted": F.sum, "chars": F.sum}


def up_the_trie(nodes: DataFrame) -> DataFrame:
    """For each node, ``SUMS`` over its subtree. After k rounds a node has what lies less than 2^k below it and looks 2^k up."""
    now = staged(nodes.withColumn("up", F.when(F.length("parent") > 0, F.col("parent"))), "trie-sums")
    while not now.filter("up is not null").isEmpty():
        below = now.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*(f(k).alias(f"more_{k}") for k, f in SUMS.items()))
        summed = {k: F.col(k) + F.coalesce(f"more_{k}", F.lit(0)) for k in SUMS} | {"least": F.least("least", "more_least")}
        ahead = now.filter("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = now.join(below, "node", "left").select("node", "up", *(v.alias(k) for k, v in summed.items())).join(ahead, "up", "left")
        new = staged(step.select("node", F.col("next").alias("up"), *SUMS), "trie-sums")
        discard(now)
        now = new
    return now.drop("up")


def trie_nodes(paths: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """One row per node of the uncompacted trie, from ``chained`` conversations."""
    paths = staged(paths, "trie-paths")
    found = paths.groupBy("key").agg(F.count("*").alias("n_ends"), F.min("conv_id").alias("least_end"), *(F.first(c).alias(c) for c in ("n", "path", "totals")))
    distinct = staged(found, "trie-distinct")
    nodes = build_trie(distinct, first, growth)
    ends = distinct.select(F.col("key").alias("node"), "n_ends", "least_end").join(ends_digests(paths.select("key", "conv_id")).withColumnRenamed("key", "node"), "node")
    ends = staged(ends, "trie-ends")

    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(ends, "node", "left").join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_ends": F.coalesce("n_ends", F.lit(0))})
    whole = F.get("totals", F.size("totals") - 1)
    own = {"n": F.col("n_ends"), "least": F.col("least_end"), "leaves": (F.col("n_children") == 0).cast("bigint"), "weighted": F.col("n_ends") * whole, "chars": whole - F.get("totals", F.lit(0))}
    counted = staged(counted.withColumns(own), "trie-counted")
    sums = up_the_trie(counted.select("node", "parent", *SUMS))

    top = counted.agg(*(F.sum(k).alias(k) for k in ("n", "leaves", "weighted", "chars"))).first()
    members = distinct.agg(F.min("least_end"), F.sum("n_ends")).first()
    if members[0] is None:
        return counted.sparkSession.createDataFrame([], OUT)
    root_children = nodes.filter("parent_depth = 0").count()
    empty_ends = ends.filter(F.length("node") == 0).first()
    root = (members[0], 0, None, members[1], root_children, top.leaves or 1, (top.weighted or 0) - (top.chars or 0), empty_ends.ends_sha256 if empty_ends else EMPTY_SHA256)
    rooted = counted.sparkSession.createDataFrame([root], OUT)

    leasts = sums.select(F.col("node").alias("parent"), F.col("least").alias("above"))
    rows = counted.drop(*SUMS).join(sums, "node").join(leasts, "parent", "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("depth") - F.col("parent_depth"))))
    last, before = F.col("step") == F.col("depth") - F.col("parent_depth"), F.get("totals", F.col("step") - 1)
    expanded = rows.select(
        F.col("least").alias("conv_id"),
        (F.col("parent_depth") + F.col("step")).cast("bigint").alias("depth"),
        F.when(F.col("step") > 1, F.col("least")).when(F.col("parent_depth") == 0, F.lit(members[0])).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("n") * before - F.col("chars") + before - F.get("totals", F.lit(0))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    discard(paths, distinct, nodes, ends)
    return expanded.unionByName(rooted)


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
