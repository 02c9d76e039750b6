"""Fingerprints, token files, BPE, packing and quality rules against brute force."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given as given_texts
from hypothesis import settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import exact_bpe, fingerprints, packing, quality_rules, token_ids, wavelet_ids
from fieldloom.llm.token_ids import TextEncoder

from .cases import documents, empty, rows, words

BYTES, LOWER = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


LIBRARY = Tokenizer.from_file(BYTES)
#: An encoder that forgets soon.
SMALL = TextEncoder(BYTES, cached=8)


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    """The cases and a whole table."""
    return documents(spark).select("doc_id", "text", "n_words").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "n_chars as n_words"))


@pytest.fixture(scope="module")
def texts(given):
    return [(r.doc_id, r.text or "") for r in given.collect()]


def ids_of(text):
    return Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "", "\n b", "a \n b", "x\t y", "  ", "a  b", "it's 'x 's", "a<|endoftext|> b", "a \x1cb", "\x85 b", "a  b", "\0 a\0"])
def test_encoder_is_the_library(text):
    code = TextEncoder(BYTES)
    for _ in range(2):
        assert np.frombuffer(code.encode([text])[0], code.dtype).tolist() == ids_of(text)


def test_wavelet_matrix_answers(monkeypatch):
    ids = np.random.default_rng(1).zipf(1.4, 5000) % 700
    ids = ids.astype("<u2")
    monkeypatch.setattr(wavelet_ids, "BLOCK", 1 << 9)
    monkeypatch.setattr(wavelet_ids, "HELD_BLOCKS", 3)
    matrix = wavelet_ids.StoredMatrix(wavelet_ids.WaveletMatrix.build(ids).pack())
    assert matrix.all().tolist() == ids.tolist()
    assert [matrix.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for value in (1, 2, 77, 699, 4000):
        places = np.flatnonzero(ids == value).tolist()
        assert matrix.count(value) == len(places) and matrix.occurrences(value) == places
        assert matrix.rank(value, 1234) == sum(p < 1234 for p in places)
        assert matrix.select(value, len(places)) == -1


def test_token_files_come_back(given, texts):
    shards = wavelet_ids.write_shards(given, BYTES, shard_tokens=20_000)
    assert shards.count() > 3
    got = wavelet_ids.read_documents(shards).collect()
    tok = Tokenizer.from_file(BYTES)
    want = {}
    for doc_id, text in texts:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want.setdefault(doc_id, (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got)
    start = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == start
        start += r.n_tokens


def test_bpe_is_the_library(given, texts):
    tok = Tokenizer.from_file(LOWER)
    tok.no_truncation()
    want = {}
    for doc_id, text in texts:
        ids = tok.encode(text, add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = exact_bpe.encode_documents(given, LOWER).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert exact_bpe.encode_documents(given.limit(2), LOWER, texts=True).columns[-1] == "decoded"


def test_packing_holds_every_id_once(given, texts):
    got = packing.pack(given, BYTES).collect()
    tok = Tokenizer.from_file(BYTES)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in dict(texts).items():
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        copies = sum(d == doc_id for d, _ in texts)
        assert sum(r.length for r in by_doc[doc_id]) == len(ids) * copies
        for r in by_doc[doc_id]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.ids_crc32, r.doc_tokens, r.length) == (zlib.crc32(part.tobytes()), len(ids), len(part))
    padding = total = 0
    for parts in by_sequence.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
        total += size
    assert padding < 0.002 * total


def test_packer_takes_the_least_sum_of_squares():
    packer = packing.Packer(8)
    for i, n in enumerate([5, 5, 3, 2, 6, 2]):
        packer.document(i, np.zeros(n, "<u2"))
    # 5 and 3 fill a window; so do 6 and 2; the level of 5 keeps one window
    assert sorted(sum(len(p[2]) for p, s, _ in packer.done if s == k) for k in range(packer.sequence)) == [8, 8]


def test_packer_holds_few_windows_of_pieces_that_never_fit():
    packer, cut = packing.Packer(1024), [(600, 50_000), (700, 3_000)]
    documents = [np.arange(i, i + n, dtype="<u4") for n, times in cut for i in range(times)]
    most = 0
    for i, ids in enumerate(documents):
        packer.document(i, ids)
        most = max(most, packer.n_open)
        assert packer.n_open == packer.count.sum() or i % 5_000
    assert most <= 4 * 1024 + 1
    packer.drain()
    assert not packer.n_open and not any(packer.open)
    held, sizes = defaultdict(list), Counter()
    for (i, start, ids, n), sequence, offset in packer.done:
        assert offset == sizes[sequence] and n == len(documents[i])
        sizes[sequence] += len(ids)
        held[i].append((start, ids))
    assert all(np.array_equal(np.concatenate([x for _, x in sorted(held[i], key=lambda p: p[0])]), ids) for i, ids in enumerate(documents))
    assert sum(n != 1024 for n in sizes.values()) <= 10 and all(n & (n - 1) == 0 for n in sizes.values())


def test_cached_pieces_are_bounded_by_bytes():
    made = []
    pieces = token_ids.Pieces(lambda p: made.append(p) or p.encode(), 100_000)
    assert [pieces[f"w{i % 5_000}"] for i in range(20_000)] == [f"w{i % 5_000}".encode() for i in range(20_000)]
    assert (len(pieces) + len(pieces.older)) * pieces.ENTRY <= 100_000
    for _ in range(2):
        assert pieces["long" * 100] == b"long" * 100
    assert made.count("long" * 100) == 2 and "long" * 100 not in pieces
    assert pieces["w1"] == b"w1" and pieces["w1"] == b"w1"


def brute_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_verdict(given, texts):
    got = quality_rules.judge(given).collect()
    assert len(got) == len(texts)
    known = dict(texts)
    for r in got:
        counts = brute_counts(known[r.row.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    kept = {r.row.doc_id for r in got if r.kept}
    assert {3, 4, 5, 6} <= kept and not kept & {1, 2, 7, 8, 9, 13}


def test_quality_follows_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows_ = quality_rules.judge(docs).selectExpr("row.doc_id as doc_id", "base_failed", "kept").join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows_ if r.quality == 1]
    bad = [r.kept for r in rows_ if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_rules_are_ordered_by_rejections_per_second(spark):
    df = spark.createDataFrame([(" ".join(f"a{i}#" for i in range(60)),)] * 20, "text string")
    rates = [rate for _, rate in quality_rules.rejections_per_second(df, quality_rules.rules())]
    assert rates == sorted(rates, reverse=True) and rates[0] > 0


def shingles_of(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_estimate_containment(given, texts):
    got = fingerprints.edited_fingerprints(given).collect()
    assert len(got) == len(texts)
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        after, third = order[(i + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    key = lambda x: (str(x[0]), x[1], x[2])
    errors = []
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == w[:3]
        a, b = shingles_of(w[3]), shingles_of(w[4])
        if len(a) > 150:
            errors.append(abs(r[5] - len(a & b) / min(len(a), len(b))))
        assert (r[3] == r[4]) == (r[5] == 1.0 and len(r[3]) == len(r[4])) or r[5] < 1
    assert sum(errors) / len(errors) < 0.06
    same = defaultdict(set)
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        same[w[3]].add(r[3])
    assert all(len(v) == 1 for v in same.values())


def test_a_part_is_contained_in_the_whole(spark):
    whole = words(5000, 9)
    df = spark.createDataFrame([(whole, " ".join(whole.split()[1000:1400]))], "a string, b string")
    assert df.select(fingerprints.likeness(fingerprints.sketch(df.a), fingerprints.sketch(df.b))).first()[0] > 0.95


def test_fingerprints_of_short_texts(spark):
    """Edited texts of 5 to 150 shingles, short passages of a long text, and parts that make up a whole."""
    like = fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    pairs = []
    for n in range(5, 151):
        a = words(n + 4, n).split()
        pairs.append((" ".join(a), " ".join(a[: len(a) - n // 3] + words(n // 3, 1000 + n).split())))
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("like", like).collect():
        a, b = shingles_of(r.a), shingles_of(r.b)
        assert abs(r.like - len(a & b) / min(len(a), len(b))) < 1e-9
    whole = words(5000, 9).split()
    inside = [(" ".join(whole), " ".join(whole[i : i + n])) for n in (1, 5, 10, 20) for i in range(0, 4900, 50)]
    got = spark.createDataFrame(inside[98:], "a string, b string").withColumn("like", like).collect()
    assert all(r.like in (1.0, None) for r in got)
    for n, most in ((5, 65), (10, 8), (20, 0)):
        assert sum(r.like is None for r in got if len(r.b.split()) == n) <= most
    parts = spark.createDataFrame([(" ".join(whole), " ".join(whole[:2000]), " ".join(whole[1996:]))], "a string, b string, c string")
    whole_, *part = parts.select(*[fingerprints.sketch(F.col(c)) for c in "abc"]).first()
    assert set(whole_) == set(part[0]) | set(part[1])


def test_merged_sketches_are_those_of_the_whole(spark):
    """Parts that overlap by the four words of a border, of sizes on both sides of SHORT."""
    rows_ = []
    for seed, (n, at) in enumerate([(20, 9), (140, 70), (200, 100), (200, 190), (320, 160), (600, 20), (3000, 1500), (290, 10), (6, 5)]):
        w = words(n, 400 + seed).split()
        rows_.append((" ".join(w), " ".join(w[:at]), " ".join(w[max(0, at - 4) :])))
    df = spark.createDataFrame(rows_, "a string, b string, c string")
    a, b, c = (fingerprints.sketch(F.col(x)) for x in "abc")
    got = df.select(a.alias("a"), fingerprints.merge(b, c).alias("m"), "b").collect()
    assert all(set(r.a) <= set(r.m) for r in got)
    # A part of fewer than five words has a shingle of its own, which the whole has not.
    assert all(len(r.m) == len(r.a) for r in got if len(r.b.split()) >= 5 and len(r.a) > 2)


WORDISH = st.text(st.sampled_from("abzAé'ßłα1 \n\t.,-!日 \u00a0\u0301"), max_size=40)


@settings(max_examples=400, deadline=None)
@given_texts(st.lists(WORDISH, max_size=4))
def test_encoder_is_the_library_on_any_text(some):
    code = SMALL
    want = [x.ids for x in LIBRARY.encode_batch(some, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(some)] == want


def test_shards_answer_as_spark_jobs(spark):
    """Counts, places and single ids over several shards, against the library's ids."""
    docs = spark.createDataFrame([(i, words(60, i)) for i in range(40)], "doc_id long, text string")
    shards = wavelet_ids.write_shards(docs, BYTES, shard_tokens=600)
    ids = {r.doc_id: [*ids_of(r.text), 2] for r in docs.collect()}
    token = ids[3][5]
    want = {(d, i) for d, x in ids.items() for i, t in enumerate(x) if t == token}
    assert {(r.doc_id, r.place) for r in wavelet_ids.occurrences(shards, token).collect()} == want
    counts = wavelet_ids.token_counts(shards, token).collect()
    assert len(counts) == shards.count() > 5 and sum(r.n for r in counts) == len(want)
    asked = spark.createDataFrame([(d, p) for d in (0, 7, 39, 99) for p in (0, 3, 50, 10_000, -1)] + [(None, 0)], "doc_id long, place long")
    got = {(r.doc_id, r.place): r.token for r in wavelet_ids.tokens_at(shards, asked).collect()}
    assert got == {(d, p): ids[d][p] for d in (0, 7, 39) for p in (0, 3, 50)}
    assert wavelet_ids.occurrences(shards.limit(0), token).count() == 0


def test_empty_tables(spark):
    none = empty(spark)
    assert wavelet_ids.read_documents(wavelet_ids.write_shards(none, BYTES)).count() == 0
    assert exact_bpe.encode_documents(none, LOWER).count() == 0
    assert packing.pack(none, BYTES).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_cases_are_covered():
    assert {type(r[0]) for r in rows()} == {int, type(None)} and any(len(r[1] or "") > 100_000 for r in rows())


def test_new_words_are_told_without_the_pattern(monkeypatch):
    """Words in ASCII, alone or with a mark, never reach the patterns; their ids are the library's."""
    path = BYTES
    code = token_ids.TextEncoder(path)
    texts = ["Zorblat quixelom, vrandish; a b! x", " lead. Trail? ", "isn't it.. 7th 1,5 a,b ,", "Čeština naïve, straße.", ""]
    want = [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == want
    seen = []
    kept = token_ids._WORD
    monkeypatch.setattr(token_ids, "_WORD", type("Told", (), {"fullmatch": staticmethod(lambda p: seen.append(p) or kept.fullmatch(p))}))
    token_ids.TextEncoder(path).encode(texts[:1] + ["plain words. only, here"])
    assert set(seen) <= {",", ".", ";", "!"}


def test_pieces_are_counted_by_what_they_take():
    """A thousand short pieces are kept in 400,000 bytes, and the bound holds for what they really take."""
    made = []
    pieces = token_ids.Pieces(lambda p: made.append(p) or p.encode(), 400_000)
    for _ in range(2):
        for i in range(1000):
            assert pieces[f"w{i}"] == f"w{i}".encode()
    assert len(made) == 1000
    table = sys.getsizeof(pieces) + sum(sys.getsizeof(x) for k in pieces.items() for x in k)
    older = sys.getsizeof(pieces.older) + sum(sys.getsizeof(x) for k in pieces.older.items() for x in k)
    assert table + older <= 400_000


def test_distinct_pieces_are_looked_up_once_a_slice():
    """However often a word comes, beside line breaks, stops and commas too, a slice asks for it once and encodes it once."""

    class Asked(token_ids.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    asked, code = [], TextEncoder(BYTES)
    code.pieces = Asked(code._piece, 1_000_000)
    texts = ["The vrandish, the naïve.\nThe vrandish quixelom, 3.5 of it.", "quixelom the.\nthe, vrandish"] * 40
    found = code.encode(texts)
    assert [np.frombuffer(x, code.dtype).tolist() for x in found] == [ids_of(t) for t in texts]
    assert len(asked) == len(set(asked)) and {" vrandish", " the", "the", ",", ".", "\n"} <= set(asked)


@pytest.mark.parametrize("text", ["a.\n\nb, c", "a.\n b", "a.\r\nb", "a .b ,c", "a...b,,c.", "3.14,15 ²,½.x", "a\n\tb", "a\x85\nb", "\n", ",.\n", "'s,'ll.\n'", "ª,µ.\nŉ", "да.\nнет,", "a\u3000\nb", "\n\u2028b"])
def test_cuts_at_breaks_and_marks_are_the_librarys(text):
    for code in (TextEncoder(BYTES), SMALL):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode([text, "", text])] == [ids_of(text), [], ids_of(text)]


def test_new_words_with_marks_are_told_without_the_pattern(monkeypatch):
    """Words with marks or digits behind them are encoded with the other new words; their ids are the library's."""
    texts = ["Zorblat$$$ quixelom*** vrandish%%% naïve&&& TROBE!!", "the9 straße12_ a-- ŉx] b~9!", "Été#1 (no)"]
    want, seen = [ids_of(t) for t in texts], []
    for name in ("_PLAIN", "_WORD"):
        kept = getattr(token_ids, name)
        monkeypatch.setattr(token_ids, name, type("Told", (), {"fullmatch": staticmethod(lambda p, kept=kept: seen.append(p) or kept.fullmatch(p))}))
    code = TextEncoder(BYTES)
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == want
    assert set(seen) <= {" (no)", " (", "no", ")"}


@pytest.mark.parametrize("text", ["it's$$ d'a1 'tis' l'été***", "a$'s b1'll", "$$$ 12 _a _", "ªb$ µ1 ºº##", "Ǆx$$ да$$ 字!!", "a$ b$\n$c$\nd,$e.$", "x\u0301$$ y²$", "Ÿž9.5 ſ$,9"])
def test_marks_behind_words_are_the_librarys(text):
    for code in (TextEncoder(BYTES), SMALL):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode([text, text + " " + text])] == [ids_of(text), ids_of(text + " " + text)]


def test_words_are_encoded_once_a_slice_however_little_is_kept():
    told, code = [], TextEncoder(BYTES, cached=8)
    kept = code.tokenize
    code.tokenize = lambda run: told.append(run) or kept(run)
    texts = ["".join(f" zorb{a}{b}" for b in "abcdefghijklmnopqrst") for a in "abcdefghijklmnopqrstuvwxyzàéîöū"] * 2
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(told) == len(set(told)) == 620


def test_planes_are_dealt_in_runs(monkeypatch):
    """Runs shorter than the plane, with a short one at the end, give the planes and the ids that masks give."""
    monkeypatch.setattr(wavelet_ids, "DEALT", 1 << 6)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = np.random.default_rng(n).integers(0, 700, n).astype("<u2")
        built, left = wavelet_ids.WaveletMatrix.build(ids, 10), ids
        for level in range(10):
            one = (left >> (9 - level) & 1).astype(bool)
            assert built.planes[level].tolist() == np.packbits(one, bitorder="little").tolist()
            left = np.concatenate((left[~one], left[one]))
        assert wavelet_ids.StoredMatrix(built.pack()).all().tolist() == ids.tolist()
