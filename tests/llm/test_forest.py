"""The LSH forest: recall against all pairs, links by the distance to a centre, and rows in proportion to a group of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import jaccard_join as jj

from .cases import words


def edited(base: list[str], share: float, r: random.Random, i: int) -> str:
    """A copy in which about this share of the words is replaced, in runs, so that similarities from 0.6 up occur."""
    w, at = list(base), 0
    while at < len(w):
        if r.random() < share / 4:
            for k in range(at, min(len(w), at + 4)):
                w[k] = f"n{i}x{k}"
            at += 4
        at += 1
    return " ".join(w)


@pytest.fixture(scope="module")
def family_texts():
    r = random.Random(8)
    out = []
    for family in range(250):
        base = words(r.randrange(40, 240), 1000 + family).split()
        share = r.choice([0.01, 0.02, 0.025, 0.03])
        out += [edited(base, share, r, 100 * family + i) for i in range(r.choice([3, 6, 10, 16]))]
    return out


def links_of(texts):
    sets = [jj.shingle_hashes(t) for t in texts]
    shared = jj.shared_counts(sets)
    sizes = np.array([len(s) for s in sets])
    near = 1.8 * shared >= 0.8 * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(near, False)
    return near, shared / (sizes[:, None] + sizes[None, :] - shared)


def test_recall_near_the_threshold(spark, family_texts):
    texts = list(dict.fromkeys(family_texts))
    near, likeness = links_of(texts)
    low = near & (likeness < 0.9)
    assert len(texts) > 1200 and near.sum() / 2 > 1500 and low.sum() / 2 > 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jj.near_duplicates(docs).collect()}
    found = sum(got[i].n_links for i in range(len(texts)))
    assert 0.99 * near.sum() <= found <= near.sum()
    pairs = np.argwhere(np.triu(low))
    together = [got[int(i)].class_id == got[int(j)].class_id for i, j in pairs]
    assert sum(together) >= 0.99 * len(together)
    assert all(got[i].n_links == 0 or near[i].any() for i in range(len(texts)))


def test_near_copies_shrink_to_leaders(spark):
    """2,000 near copies: pairs, open texts and entries that stay are in proportion to the texts; links are all counted."""
    base, r, n = words(200, 5).split(), random.Random(3), 2000
    texts = []
    for i in range(n):
        w = list(base)
        w[r.randrange(200)] = f"new{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = jj.staged(jj.signed(docs).select(F.xxhash64("key").alias("id"), "signature"), "test-classes")
    entries = jj.trie_entries(classes, 5)
    before = entries.count()
    left, edges, least = jj.level(entries, 8, jj.THRESHOLD)
    assert sum(e.count() for e in edges) <= 5 * n and left.count() < before / 4 and 0.8 <= least <= 1
    assert jj.candidate_edges(classes).count() <= 5 * n
    got = jj.near_duplicates(docs).collect()
    assert len(got) == n and {r.class_id for r in got} == {1} and {r.n_links for r in got} == {n - 1}
    named = docs.select("doc_id", jj.key_of(F.col("text")).alias("key"), F.lit(1).cast("long").alias("component"), F.lit(n).cast("long").alias("size"))
    members = jj.own_texts(docs, named)
    assert members.count() == n


def test_leaders_capture_and_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 250, 160).astype(np.uint8)
    rows = [base.copy() for _ in range(40)]
    for i, x in enumerate(rows):
        x[rng.permutation(160)[: i]] = 255 - i % 4
    found = jj.led(np.stack(rows))
    assert all(agree >= 1 - jj.EDGE for _, _, agree, _ in found)
    assert {j for _, j, _, captured in found if captured} >= set(range(1, 17)) and len(found) <= 2 * len(rows)
    assert jj.led(np.stack(rows[:1])) == []


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_any_centre_gives_the_links(spark, threshold):
    """The count by cost and open pairs equals the plain count, whichever texts vote for the centre."""
    r = random.Random(4)
    base = words(80, 6).split()
    texts = [edited(base, r.choice([0.0, 0.05, 0.2, 0.5]), r, i) for i in range(60)] + [words(30, 99), "one two", "one two three four five six"]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (len(texts), 10**9):  # of so large a size no text votes: every centre is empty
        candidates = docs.select("doc_id", jj.key_of(F.col("text")).alias("key"), F.lit(1).cast("long").alias("component"), F.lit(size).cast("long").alias("size"))
        links, _ = jj.verified(docs, candidates, threshold)
        got = {bytes(r.key): r.n_links for r in links.collect()}
        sets = [jj.shingle_hashes(t) for t in texts]
        shared = jj.shared_counts(sets)
        sizes = np.array([len(s) for s in sets])
        near = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(near, False)
        assert [got.get(jj.text_key(t), 0) for t in texts] == near.sum(axis=1).tolist()
