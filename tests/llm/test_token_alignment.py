"""Alignment of two tokenizers against a plain walk over both libraries' whole encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given as given_texts
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import token_alignment
from fieldloom.llm.token_alignment import Fragment

from .cases import SCHEMA, documents, empty, words

PATH_A, PATH_B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOOL = token_alignment.Aligner(PATH_A, PATH_B)
A, B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True
ODD = ["a  b", " a", "a ", "   ", "\n b", "a \n b", "x\t  y  ", "it's 'x", "a<|endoftext|> b", "▁x", "a\0b \0", "\x85 b", "日本語 テキスト", "é ﬁ \U0001f600", "</s> <s> <unk> <0x41>", "﻿ x", "\xa0 y"]


def plain(text):
    """Ids of both sides and the groups, or none."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a, bytes_b = [TOOL.a.token_bytes[i] for i in a], [TOOL.b.token_bytes[i] for i in b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    both, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for end in both:
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def plain_table(texts):
    found = [(doc_id, plain(text)) for doc_id, text in texts]
    links = Counter((g[0][-1], g[1][-1]) for _, x in found if x for g in x[2])
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        counts = [(links[g[0][-1], g[1][-1]], best[g[1][-1]]) for g in x[2]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in x[2])
        out.append((doc_id, len(x[0]), len(x[1]), len(x[2]), len(x[2]), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [token_alignment.RANGE, 40])
def test_alignment_is_the_plain_walk(spark, sf_dir, size):
    more = [(100 + i, text, "en", "a", 0, 0) for i, text in enumerate([*ODD, "x" * 500, words(60, 5).replace(" ", " \n  "), words(90, 6) + "▁"])]
    cases = documents(spark).unionByName(spark.createDataFrame(more, SCHEMA))
    given = cases.select("doc_id", "text", "n_words").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "n_chars as n_words"))
    if size < 100:
        given = given.filter("length(text) < 3000")
    got = token_alignment.align_documents(given, PATH_A, PATH_B, size).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_table([(r.doc_id, r.text) for r in given.collect()])


def test_empty_table(spark):
    assert token_alignment.align_documents(empty(spark), PATH_A, PATH_B).collect() == []


TEXTS = st.text(st.sampled_from("ab éß.,'\n\t ▁日<|>s0\x1c"), max_size=60)


@settings(max_examples=300, deadline=None)
@given_texts(TEXTS)
def test_words_are_encoded_as_in_the_whole(text):
    (a, b), whole = TOOL.tokens([" " + text])[0] if text else (None, None), plain(text)
    if whole is None:
        assert a is None or b is None
    else:
        assert a.tolist() == whole[0] and b.tolist() == whole[1]


@settings(max_examples=200, deadline=None)
@given_texts(st.integers(0, 10**6), st.integers(2, 9))
def test_any_tree_of_fragments_gives_the_whole(seed, n):
    """Token ends of both sides cut at places of their own, joined in a random tree."""
    r = random.Random(seed)
    sides = []
    for _ in range(2):
        ends = sorted({60, *r.sample(range(1, 60), r.randrange(25))})
        cuts = sorted(r.randrange(len(ends) + 1) for _ in range(n - 1))
        sides.append((np.array([r.randrange(900) for _ in ends]), np.array(ends), [0, *cuts, len(ends)]))
    (a, ends_a, cuts_a), (b, ends_b, cuts_b) = sides
    whole = TOOL.finish(TOOL.fragment(a, b, ends_a, ends_b))
    parts = [TOOL.fragment(*(x[c[i] : c[i + 1]] for x, c in ((a, cuts_a), (b, cuts_b), (ends_a, cuts_a), (ends_b, cuts_b)))) for i in range(n)]
    while len(parts) > 1:
        i = r.randrange(len(parts) - 1)
        parts[i : i + 2] = [TOOL.compose(parts[i], parts[i + 1])]
    got = TOOL.finish(parts[0])
    assert isinstance(got, Fragment) and got.n == whole.n
    assert ";".join(got.groups) == ";".join(whole.groups)
    assert np.concatenate(got.links).tolist() == np.concatenate(whole.links).tolist()


def test_linked_tokens_end_alike():
    """The bound on the number of pairs."""
    for text in [words(200, 7), *ODD]:
        for _, (a, b) in [(0, (g[0][-1], g[1][-1])) for g in (plain(text) or ([], [], []))[2]]:
            one, two = TOOL.a.token_bytes[a], TOOL.b.token_bytes[b]
            assert one.endswith(two) or two.endswith(one)
    assert TOOL.most_pairs() < 1_000_000


def test_distinct_words_are_encoded_and_looked_up_once():
    """A slice asks B's side for each distinct word once, however often it comes; texts with a word that isn't given back have none."""

    class Asked(token_alignment.SideB):
        def _found(self, distinct):
            asked.extend(distinct)
            return super()._found(distinct)

    asked, side = [], Asked(PATH_B)
    texts = [" the vrandish quixelom, the end.", " quixelom the", " ▁x the"] * 40
    found = side.encode(texts)
    assert len(asked) == len(set(asked)) and "the" in asked
    assert [np.frombuffer(x, side.dtype).tolist() for x in found[:2]] == [B.encode(t[1:]) for t in texts[:2]]
    assert found == found[:3] * 40 and found[2] is None
