"""Alignment of two tokenizers' tokens, by fragments that compose in any grouping.

Both tokenizers split the same bytes. Where a token of A and one of B end at the same byte, a group closes. A byte range of a document
gives a fragment: an open prefix up to the first such end, since what closes there may begin before the range; closed groups; and an open
suffix, which a later range will close. Fragments compose: the left one's suffix and the right one's prefix become closed groups or stay
open. Composition is associative, so the ranges of a very long document are encoded in different tasks and joined in a tree, of which only
the open ends travel; closed groups stay where they are.

A range begins, for each tokenizer by itself, at the first place from its nominal start on where that tokenizer may be cut without a change
of its tokens; so the two sides of a range may begin at different bytes, which composition allows for.

Two tokens that end together have one's bytes at the end of the other's. So the pairs that can ever be linked are fewer than the bytes of
both vocabularies (``most_pairs``), and the table of their counts has a size that no corpus exceeds: it goes to every task.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by byte behind one space, has no tokens:
zeros and an empty string. Repeated rows give repeated rows, each of which counts; null doc_ids stay null; an empty table gives an empty
table; other columns are ignored. A run without a place to cut is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import staged, text_of
from fieldloom.llm.token_ids import TextEncoder, byte_characters, joined, slices

#: Code points of a range.
RANGE = 16_384
#: Fragments that one step of the tree joins.
FAN = 16
#: Documents that are encoded, or whose links are looked up, at once.
LOOKED_UP = 256
#: Words kept in one Python worker, and the longest of them.
CACHED, LONGEST = 150_000, 64
#: New words that are encoded at once.
LEARNT = 256
#: Bytes that the other side's pieces take in it: about as many pieces.
CACHED_BYTES = 44_000_000

_CUT_A, _CUT_B = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])"), re.compile(r"(?<=[^ ])(?= )")


class SideA(TextEncoder):
    """A byte-level tokenizer in which the strings of special tokens are text."""

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        super().__init__(path, cached)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in byte_characters().items()}
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(map(back.__getitem__, token))


class SideB:
    """A piece tokenizer that adds a space in front and has none inside its pieces, so that words are encoded one by one."""

    def __init__(self, path: str, cached: int = CACHED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.cached = self.model.get_piece_size(), cached
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces with a space inside: words can't be encoded one by one")
        self.token_bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.space = [self.model.piece_to_id("▁")]
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _learn(self, words: list[str], known: dict[str, bytes | None]) -> None:
        """Ids of words (without the space before them); none where they don't give the word back."""
        packed = (lambda ids: array("H", ids).tobytes()) if self.dtype.itemsize == 2 and sys.byteorder == "little" else (lambda ids: np.array(ids, self.dtype).tobytes())
        for word, ids in zip(words, self.model.encode(words, num_threads=1), strict=True):
            ids = ids or self.space
            right = b"".join(map(self.token_bytes.__getitem__, ids)) == b" " + word.encode()
            known[word] = packed(ids) if right else None

    def _found(self, distinct: list[str]) -> list[bytes | None]:
        """Packed ids of distinct words; none where they don't give the word back."""
        if len(self.words) > self.cached // 2:
            self.older, self.words = self.words, {}
        words, older, long, new = self.words, self.older, {}, []
        for w in distinct:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                elif len(w) <= LONGEST:
                    new.append(w)
                else:
                    self._learn([w], long)
        for at in range(0, len(new), LEARNT):
            self._learn(new[at : at + LEARNT], words)
        return [words[w] if w in words else long[w] for w in distinct]

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Per text, which begins with the space added in front, its packed ids; none where they don't give the text back."""
        plain = iter(joined([text[1:] for text in texts if "  " not in text], " ", self._found))
        found = []
        for text in texts:
            if "  " in text:
                units = [unit[1:] for unit in _CUT_B.split(text)]
                known = dict.fromkeys(units)
                known = dict(zip(known, self._found(list(known)), strict=True))
                parts = [known[w] for w in units]
                found.append(None if None in parts else b"".join(parts))
            else:
                found.append(next(plain))
        return found


@dataclass
class Fragment:
    """Tokens of a byte range, each with the byte where it ends: all open (``closed`` false: they are the prefix), or prefix, groups, suffix.
    ``groups`` has texts, ``links`` the linked pairs, ``n`` the number of groups; ``end`` is the byte where what closed last ends."""

    prefix: tuple = ((), (), (), ())
    suffix: tuple = ((), (), (), ())
    closed: bool = False
    groups: list[str] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    end: int = 0


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.sizes = [np.array([len(t) for t in side.token_bytes], np.int64) for side in (self.a, self.b)]
        most = max(self.a.size, self.b.size)
        # Decimal ids with what may follow them, in an order that ``_text`` knows.
        self.decimal = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], dtype=object)
        self.most = most

    def most_pairs(self) -> int:
        """Pairs of tokens in which one's bytes end as the other's do: at most one for each end of each token's bytes."""
        return int(self.sizes[0].sum() + self.sizes[1].sum())

    def _text(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Groups of ids, where the cuts mark each group's last ones."""
        marks = [np.zeros(len(ids), np.int64) for ids in (a, b)]
        marks[0][cut_a], marks[1][cut_b] = 1, 2
        sizes = [cuts - np.concatenate(([-1], cuts[:-1])) for cuts in (cut_a, cut_b)]
        # A group's tokens of A stand behind those of B in the groups before, its tokens of B behind those of A up to it.
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.repeat(cut_b + 1 - sizes[1], sizes[0])] = a + marks[0] * self.most
        shown[np.arange(len(b)) + np.repeat(cut_a + 1, sizes[1])] = b + marks[1] * self.most
        return "".join(self.decimal[shown].tolist())[:-1]

    def fragment(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
        places = np.searchsorted(ends_b, ends_a)
        at_a = np.flatnonzero(ends_b[np.minimum(places, len(ends_b) - 1)] == ends_a) if len(ends_b) else ()
        if not len(at_a):
            return Fragment((a, b, ends_a, ends_b))
        at_b = places[at_a]
        (i, j), (k, m) = (at_a[0] + 1, at_b[0] + 1), (at_a[-1] + 1, at_b[-1] + 1)
        out = Fragment((a[:i], b[:j], ends_a[:i], ends_b[:j]), (a[k:], b[m:], ends_a[k:], ends_b[m:]), True, end=int(ends_a[at_a[-1]]))
        if len(at_a) > 1:
            inner_a, inner_b = a[i:k].astype(np.int64), b[j:m].astype(np.int64)
            cut_a, cut_b = at_a[1:] - i, at_b[1:] - j
            out.groups, out.n = [self._text(inner_a, inner_b, cut_a, cut_b)], len(cut_a)
            out.links = [inner_a[cut_a] * self.b.size + inner_b[cut_b]]
        return out

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        joint = self.fragment(*(np.concatenate([x, y]) for x, y in zip(left.suffix if left.closed else left.prefix, right.prefix, strict=True)))
        if not joint.closed:  # then neither side of the joint has a shared end: the right one is open
            return Fragment(left.prefix, joint.prefix, True, left.groups, left.links, left.n) if left.closed else joint
        groups, links, n = joint.groups, joint.links, joint.n
        if left.closed:  # the left edge of the joint is closed, so its first group is one too
            first = self.close(joint.prefix)
            groups, links, n = left.groups + first.groups + groups, left.links + first.links + links, left.n + 1 + n
        if right.closed:
            groups, links, n = groups + right.groups, links + right.links, n + right.n
        return Fragment(left.prefix if left.closed else joint.prefix, right.suffix if right.closed else joint.suffix, True, groups, links, n, joint.end)

    def close(self, tokens: tuple) -> Fragment:
        """The one group that these tokens are."""
        a, b = (np.asarray(x, np.int64) for x in tokens[:2])
        return Fragment(closed=True, groups=[self._text(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))], links=[a[-1:] * self.b.size + b[-1:]], n=1)

    def finish(self, whole: Fragment) -> Fragment:
        """Of all ranges of a text: what is open at its start begins with the text."""
        first = self.close(whole.prefix)
        return Fragment(closed=True, groups=first.groups + whole.groups, links=first.links + whole.links, n=1 + whole.n)

    def tokens(self, texts: list[str], sides: str = "ab") -> list[list[np.ndarray | None]]:
        """Per text and side its ids; none where the side doesn't give the text's bytes back."""
        out = []
        for side, name, sizes in ((self.a, "a", self.sizes[0]), (self.b, "b", self.sizes[1])):
            if name in sides:
                ids = [None if packed is None else np.frombuffer(packed, side.dtype) for packed in side.encode(texts)]
                out.append([x if x is not None and sizes[x].sum() == len(t.encode()) else None for x, t in zip(ids, texts, strict=True)])
        return list(zip(*out, strict=True))

    def of_text(self, a: np.ndarray, b: np.ndarray, at_a: int = 0, at_b: int = 0) -> Fragment:
        return self.fragment(a, b, at_a + np.cumsum(self.sizes[0][a]), at_b + np.cumsum(self.sizes[1][b]))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def ranges(text: str, size: int) -> Iterator[tuple[str, str, int, int]]:
    """Per range of a text (with its space in front) what A and B encode there, and at which byte each begins."""

    def cuts(pattern: re.Pattern) -> list[int]:
        places = [0]
        for nominal in range(size, len(text), size):
            m = pattern.search(text, max(nominal, places[-1]))
            places.append(m.start() if m else len(text))
        return [*places, len(text)]

    a, b = cuts(_CUT_A), cuts(_CUT_B)
    at_a = at_b = 0
    for k in range(len(a) - 1):
        one, two = text[a[k] : a[k + 1]], text[b[k] : b[k + 1]]
        yield one, two, at_a, at_b
        at_a, at_b = at_a + len(one.encode()), at_b + len(two.encode())


#: A table of parts. ``at``: -1 in a row that speaks for a whole document, else the byte where the part's last group ends.
PARTS = "row long, doc_id long, at long, n_a long, n_b long, n_groups long, ok boolean, sha string, groups string, links binary"
_EDGE = "prefix struct<a:array<int>,b:array<int>,ea:array<bigint>,eb:array<bigint>>, suffix struct<a:array<int>,b:array<int>,ea:array<bigint>,eb:array<bigint>>, closed boolean"
_TOKENS = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("ea", pa.list_(pa.int64())), ("eb", pa.list_(pa.int64()))])
_PART_KINDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("ok", pa.bool_()), ("sha", pa.string()), ("groups", pa.string()), ("links", pa.binary())]
_EDGE_KINDS = [("prefix", _TOKENS), ("suffix", _TOKENS), ("closed", pa.bool_())]
_NO_EDGE = {"prefix": None, "suffix": None, "closed": None, "k": None}


def _packed(links: list[np.ndarray]) -> bytes:
    return np.concatenate(links).astype("<u4").tobytes() if links else b""


def _edge(f: Fragment) -> dict:
    show = lambda tokens: dict(zip(("a", "b", "ea", "eb"), (np.asarray(x).tolist() for x in tokens), strict=True))
    return {"prefix": show(f.prefix), "suffix": show(f.suffix), "closed": f.closed}


def _from_edge(edge: dict) -> Fragment:
    read = lambda tokens: tuple(np.array(tokens[x], np.int64) for x in ("a", "b", "ea", "eb"))
    return Fragment(read(edge["prefix"]), read(edge["suffix"]), edge["closed"])


def split_texts(docs: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """Short texts aligned (``k`` null), long ones as ranges to encode; ``text_b`` is null where B encodes the same."""
    schema = PARTS + ", k int, text_a string, text_b string, at_a long, at_b long"
    kinds = pa.schema([*_PART_KINDS, ("k", pa.int32()), ("text_a", pa.string()), ("text_b", pa.string()), ("at_a", pa.int64()), ("at_b", pa.int64())])
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in (whole.slice(at, LOOKED_UP) for whole in batches for at in range(0, whole.num_rows, LOOKED_UP)):
            doc_ids, at = batch.column(0).to_pylist(), 0
            for some in slices(batch.column(1).to_pylist()):
                rows, short = [], []
                for text in some:
                    row, doc_id = row + 1, doc_ids[at]
                    at += 1
                    if not text:
                        rows.append((row, doc_id, -1, 0, 0, 0, True, "", None, b"", None, None, None, None, None))
                    elif len(text) < size:
                        short.append((row, doc_id, " " + text))
                    else:
                        for k, (one, two, at_a, at_b) in enumerate(ranges(" " + text, size)):
                            rows.append((row, doc_id, 0, 0, 0, 0, True, None, None, None, k, one, None if one == two else two, at_a, at_b))
                for (key, doc_id, _), (a, b) in zip(short, tool.tokens([t for *_, t in short]), strict=True):
                    if a is None or b is None:
                        rows.append((key, doc_id, -1, 0, 0, 0, False, "", None, b"", None, None, None, None, None))
                        continue
                    whole = tool.finish(tool.of_text(a, b))
                    sha = hashlib.sha256(";".join(whole.groups).encode()).hexdigest()
                    rows.append((key, doc_id, -1, len(a), len(b), whole.n, True, sha, None, _packed(whole.links), None, None, None, None, None))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds.types)), names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def encode_ranges(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Ranges as fragments: a row for the open ends (``k`` the range's number), one for the closed groups (``k`` null)."""
    kinds = pa.schema([*_PART_KINDS, *_EDGE_KINDS, ("k", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for i in range(0, batch.num_rows, FAN):
                held, rows = batch.slice(i, FAN).to_pylist(), []
                texts_b = [r["text_a"] if r["text_b"] is None else r["text_b"] for r in held]
                one, two = tool.tokens([r["text_a"] for r in held], "a"), iter(tool.tokens([t for t in texts_b if t], "b"))
                for r, (a,), text_b in zip(held, one, texts_b, strict=True):
                    (b,) = next(two) if text_b else (np.zeros(0, tool.b.dtype),)
                    ok = a is not None and b is not None
                    piece = tool.of_text(a, b, r["at_a"], r["at_b"]) if ok else Fragment(*[(np.zeros(0, np.int64),) * 4] * 2)
                    same = {"row": r["row"], "doc_id": r["doc_id"], "ok": ok, "sha": None}
                    if piece.n:
                        rows.append(same | _NO_EDGE | {"at": piece.end, "n_a": 0, "n_b": 0, "n_groups": piece.n, "groups": ";".join(piece.groups), "links": _packed(piece.links)})
                    rows.append(same | _edge(piece) | {"at": -1, "n_a": len(a) if ok else 0, "n_b": len(b) if ok else 0, "n_groups": 0, "groups": None, "links": None, "k": r["k"]})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return found.mapInArrow(run, f"{PARTS}, {_EDGE}, k int")


def join_level(edges: DataFrame, path_a: str, path_b: str, last: bool) -> DataFrame:
    """Open ends of up to ``FAN`` neighbouring fragments composed; groups that close are rows of their own. In the last step, what is open at
    the start of the text closes too."""
    kinds = pa.schema([*_PART_KINDS, *_EDGE_KINDS, ("k", pa.int32())])

    def joined(tool: Aligner, group: list[dict]) -> Iterator[dict]:
        whole, same = None, {"row": group[0]["row"], "doc_id": group[0]["doc_id"], "ok": all(r["ok"] for r in group), "sha": None}
        if same["ok"]:
            for r in group:
                right = _from_edge(r)
                whole = tool.compose(whole, right) if whole else right
                if whole.n:
                    yield same | _NO_EDGE | {"at": whole.end, "n_a": 0, "n_b": 0, "n_groups": whole.n, "groups": ";".join(whole.groups), "links": _packed(whole.links)}
                    whole.groups, whole.links, whole.n = [], [], 0
            if last:
                first = tool.close(whole.prefix)
                yield same | _NO_EDGE | {"at": int(whole.prefix[2][-1]), "n_a": 0, "n_b": 0, "n_groups": 1, "groups": first.groups[0], "links": _packed(first.links)}
        else:
            whole = Fragment(*[(np.zeros(0, np.int64),) * 4] * 2)
        sums = {x: sum(r[x] for r in group) for x in ("n_a", "n_b")}
        yield same | _edge(whole) | sums | {"at": -1, "n_groups": 0, "groups": None, "links": None, "k": None if last else group[0]["k"] // FAN}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, group = aligner(path_a, path_b), []
        for batch in batches:
            rows = []
            for r in batch.drop_columns(["up"]).to_pylist():
                if group and (group[0]["row"], group[0]["k"] // FAN) != (r["row"], r["k"] // FAN):
                    rows += joined(tool, group)
                    group = []
                group.append(r)
            yield pa.RecordBatch.from_pylist(rows, kinds)
        if group:
            yield pa.RecordBatch.from_pylist(list(joined(tool, group)), kinds)

    up = F.floor(F.col("k") / FAN)
    return edges.withColumn("up", up).repartition("row", "up").sortWithinPartitions("row", "k").mapInArrow(run, f"{PARTS}, {_EDGE}, k int")


def finished(parts: DataFrame) -> DataFrame:
    """Parts of long texts in order: a document's own row comes first and is completed behind its last part; the digest reads one part at a time."""
    kinds = pa.schema(_PART_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None

        def end() -> list[dict]:
            return [own | {"sha": sha.hexdigest() if own["ok"] else ""}] if own else []

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["at"] < 0:
                    rows += end()
                    own, sha = r | {"links": b"", "groups": None}, hashlib.sha256()
                    if not r["ok"]:
                        own |= {"n_a": 0, "n_b": 0}
                elif own["ok"]:
                    sha.update((";" * (own["n_groups"] > 0) + r["groups"]).encode())
                    own["n_groups"] += r["n_groups"]
                    rows.append(r | {"groups": None, "n_groups": 0})
            yield pa.RecordBatch.from_pylist(rows, kinds)
        yield pa.RecordBatch.from_pylist(end(), kinds)

    return parts.repartition("row").sortWithinPartitions("row", "at").mapInArrow(run, PARTS)


def align(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE) -> DataFrame:
    """A staged table of parts: one row with ``sha`` for each document, and further ones with links for long ones."""
    texts = staged(split_texts(docs, path_a, path_b, size), "align-texts")
    names = [x.split()[0] for x in PARTS.split(", ")]
    short = texts.filter("k is null").select(names)
    long = texts.filter("k is not null")
    longest = long.agg(F.max("k")).first()[0]
    if longest is None:
        return short
    level = staged(encode_ranges(long.repartition("row", "k"), path_a, path_b), "align-fragments")
    parts = level.filter("k is null").select(names)
    edges = level.filter("k is not null")
    while True:
        longest //= FAN
        level = staged(join_level(edges, path_a, path_b, last=longest == 0), "align-tree")
        parts = parts.unionByName(level.filter("k is null").select(names))
        edges = level.filter("k is not null")
        if longest == 0:
            break
    return short.unionByName(staged(finished(parts), "align-long"))


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair (A's id times the size of B's vocabulary, plus B's id) and its links; each task counts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
            both, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for links in batch.column(0).to_pylist():
                held.append(np.frombuffer(links, "<u4"))
                size += len(held[-1])
                if size > 4_000_000:
                    pairs, counts = merged()
                    held, size = [], 0
        pairs, counts = merged()
        for at in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000].astype(np.int64)), pa.array(counts[at : at + 50_000])], ["pair", "n"])

    return parts.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    parts = align(docs, path_a, path_b, size)
    tool = aligner(path_a, path_b)
    table = pair_counts(parts).toArrow()
    if table.num_rows > tool.most_pairs():
        raise ValueError("more linked pairs than the vocabularies allow")
    pairs, counts = (table.column(x).to_numpy() for x in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    highest = np.zeros(tool.b.size, np.int64)
    np.maximum.at(highest, pairs % tool.b.size, counts)
    sent = docs.sparkSession.sparkContext.broadcast((pairs, counts, counts == highest[pairs % tool.b.size]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = sent.value
        for whole in batches:
            for batch in (whole.slice(at, LOOKED_UP) for at in range(0, whole.num_rows, LOOKED_UP)):
                blobs = batch.column("links").to_pylist()
                sizes = np.array([len(x) // 4 for x in blobs], np.int64)
                at = np.searchsorted(pairs, np.frombuffer(b"".join(blobs), "<u4").astype(np.int64))
                rows = np.repeat(np.arange(len(blobs)), sizes)
                sums = [np.bincount(rows, x[at], len(blobs)).astype(np.int64) for x in (best, counts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "n_a", "n_b", "n_groups", "sha")), *map(pa.array, (sizes, *sums))], names)

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "sha", "n_links", "n_best", "count_sum"]
    told = parts.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, sha string, n_links long, n_best long, count_sum long")
    sums = [F.sum(x).alias(x) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return told.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("sha").alias("groups_sha256")).drop("row")
