"""Exact token ids of whole texts by the ``tokenizers`` library, with a bounded cache of what lies between spaces.

In a byte-level tokenizer of this kind each word is merged on its own, and a word starts at a space that has no other white space after
it. So a text may be cut before such spaces, around a line break without other white space beside it, and before a full stop or comma
behind a letter or digit; equal pieces have equal ids. A piece is cut again where runs of Latin letters begin and end; such a run is one
word of the tokenizer, so the library's merges (``Tokenizer.model``) take it without another split. All other pieces, and texts where a
cut could be wrong, go to the library whole. Arrow cuts a slice of texts and tells its distinct pieces; each of these is looked up once
a slice, encoded once while the cache holds it, and Arrow puts the ids in the texts' order.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from codecs import charmap_decode
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space next to other white space: there a cut could change the ids.
_UNSAFE = re.compile(r" [\s\x1c-\x1f\x85]")
#: Letters of the blocks Latin-1 and Latin Extended-A.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: A line break next to white space (but for a space behind it, where a cut is safe), a stop and a comma that begin no word of their own.
_UNSAFE_BREAK = re.compile(r"\n(?:(?<=[\s\x1c-\x1f\x85]\n)|(?=[^\S ]|[\x1c-\x1f\x85]))")
_UNSAFE_STOP, _UNSAFE_COMMA = (re.compile(rf"{mark}(?<![0-9{_LATIN}]{mark})") for mark in (r"\.", ","))
#: Pieces whose words are runs of Latin letters; an apostrophe, a space inside or any other script may join what the runs part.
_PLAIN = re.compile(rf" ?[{_LATIN}!-&(-@\[-`{{-~\n]+")
_LATIN_WORD = re.compile(rf"[{_LATIN}]+")
#: A word and the mark behind it.
_WORD = re.compile(rf"( ?[{_LATIN}]+)([.,;:!?]?)")
_MARKS = frozenset(".,;:!?")
#: What may stand behind a word's letters without changing the word's ids: digits and marks but the apostrophe.
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha() and c != "'")
_RUNS = re.compile(rf" ?[{_LATIN}]+| ?[^{_LATIN}]+")
#: Bytes of pieces and ids kept in one Python worker.
CACHED_BYTES = 100_000_000
#: Longer pieces, such as lines of a script without spaces, hardly come again and are not kept.
LONGEST_KEPT = 64
#: New words that are encoded at once.
LEARNT = 256

_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Frees what this Python worker holds for encoding. Workers outlive a job: a stage that needs their memory for something else calls this."""
    _encoders.clear()


def byte_characters() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte: itself where it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


_size = sys.getsizeof


def weight(found) -> int:
    """Bytes that a found value takes."""
    return sys.getsizeof(found) + (sum(map(sys.getsizeof, found)) if isinstance(found, tuple) else 0)


class Pieces(dict):
    """What ``encode`` finds by piece, filled as pieces are asked for, in at most about ``most`` bytes: what is not asked for while half
    as many bytes of others come is forgotten. A long piece is encoded anew each time."""

    #: Of the entry itself: up to 44 bytes where the dictionary has just grown (as measured), and what allocation rounds up.
    ENTRY = 100

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older, self.bytes, self.learns = encode, most, {}, 0, True

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is not None:
            self.put(piece, found)
        elif self.learns:
            found = self.learn(piece)
        return found

    def held(self, pieces: list[str]) -> list:
        """What is held of each piece; none of a new one, which is not encoded."""
        self.learns = False
        try:
            return list(map(self.__getitem__, pieces))
        finally:
            self.learns = True

    def learn(self, piece: str):
        """Encodes a new piece."""
        found = self.encode(piece)
        if len(piece) <= LONGEST_KEPT:
            self.put(piece, found)
        return found

    def put(self, piece: str, found) -> None:
        self.make_room(self.ENTRY + _size(piece) + (_size(found) if type(found) is bytes else weight(found)))
        self[piece] = found

    def keep(self, pieces: list[str], found: list[bytes]) -> None:
        """Adds what was found of many pieces."""
        self.make_room(self.ENTRY * len(pieces) + sum(map(_size, pieces)) + sum(map(_size, found)))
        for piece, x in zip(pieces, found, strict=True):
            self[piece] = x

    def make_room(self, size: int) -> None:
        """For what is added next, which takes so many bytes."""
        self.bytes += size
        if self.bytes > self.most // 2:
            self.older, self.bytes = dict(self), size
            self.clear()


def joined(texts: list[str], mark: str, find) -> list[bytes | None]:
    """Packed ids of texts that are cut at each mark. ``find`` gives those of distinct pieces, or none: then a text with the piece has none."""
    if not texts:
        return []
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), mark)
    coded, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
    found = find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    taken = pa.array(found, pa.large_binary()).take(coded.indices)
    wrong = np.zeros(len(texts), bool)
    if taken.null_count:
        lost = np.concatenate(([0], np.cumsum(taken.is_null().to_numpy(zero_copy_only=False))))
        wrong = lost[offsets[1:]] > lost[offsets[:-1]]
    _, ends, packed = taken.buffers()
    packed = memoryview(packed or b"")
    bounds = np.frombuffer(ends, np.int64)[offsets].tolist()
    return [None if x else bytes(packed[a:b]) for a, b, x in zip(bounds, bounds[1:], wrong.tolist())]


class TextEncoder:
    def __init__(self, path: str, cached: int = CACHED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.short = self.dtype.itemsize == 2 and sys.byteorder == "little"
        kind = spec.get("pre_tokenizer") or {}
        by_words = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        self.cuts = bool(by_words and not spec.get("normalizer") and not spec.get("post_processor"))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.tokenize = self.tokenizer.model.tokenize
        self.characters = byte_characters()
        self.space = self.characters[32]
        self.shown = "".join(map(self.characters.__getitem__, range(256)))
        self.pieces = Pieces(self._piece, cached)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H", ids).tobytes() if self.short else np.array(ids, dtype=self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._packed(x.ids) for x in found]

    def _run(self, piece: str) -> str | None:
        """A piece that is one word of Latin letters, in the characters of its bytes."""
        spaced = piece[:1] == " "
        body = piece[1:] if spaced else piece
        if not body.isalpha():
            return None
        if not body.isascii():
            return charmap_decode(piece.encode(), "strict", self.shown)[0] if _LATIN_WORD.fullmatch(body) else None
        return self.space + body if spaced else body

    def _piece(self, piece: str) -> bytes:
        if run := self._run(piece):
            return self._packed([token.id for token in self.tokenize(run)])
        # String methods tell a word with its mark in a quarter of the pattern's time.
        body = piece[1:] if piece[:1] == " " else piece
        if body[-1:] in _MARKS and body.isascii() and body[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.pieces[body[-1]]
        if word := _WORD.fullmatch(piece):
            run, mark = word.groups()
            if mark:
                return self.pieces[run] + self.pieces[mark]
        if len(piece) > 1 and "\n\n" not in piece and _PLAIN.fullmatch(piece) and len(runs := _RUNS.findall(piece)) > 1:
            return b"".join(map(self.pieces.__getitem__, runs))
        return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _cut(self, text: str) -> str:
        """The text with a null character at each cut."""
        text = text.replace(" ", "\0 ")
        if not _UNSAFE_BREAK.search(text):
            text = text.replace("\n", "\0\n\0")
        if not _UNSAFE_STOP.search(text):
            text = text.replace(".", "\0.")
        if not _UNSAFE_COMMA.search(text):
            text = text.replace(",", "\0,")
        return text

    def _found(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces. New words, with or without marks behind them, are encoded many at a time: what they share is done once."""
        found = self.pieces.held(pieces)
        places, runs, tails, marks = [], [], [], {"": b""}
        for i in [i for i, x in enumerate(found) if x is None]:
            piece, tail = pieces[i], ""
            run = self._run(piece)
            if not run and (body := piece.rstrip(_TAIL)) != piece:
                run, tail = self._run(body), piece[len(body) :]
            if run and len(piece) <= LONGEST_KEPT:
                places.append(i)
                runs.append(run)
                tails.append(tail)
            else:
                found[i] = self.pieces.learn(piece)
        for tail in set(tails).difference(marks):
            marks[tail] = self._packed(self.tokenizer.encode(tail, add_special_tokens=False).ids)
        for at in range(0, len(places), LEARNT):
            some = places[at : at + LEARNT]
            tokens = list(map(self.tokenize, runs[at : at + LEARNT]))
            packed = self._packed([token.id for word in tokens for token in word])
            bounds = [0, *accumulate(len(word) * self.dtype.itemsize for word in tokens)]
            new = [packed[a:b] + marks[tail] for a, b, tail in zip(bounds, bounds[1:], tails[at : at + LEARNT])]
            for i, x in zip(some, new, strict=True):
                found[i] = x
            self.pieces.keep([pieces[i] for i in some], new)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as packed little-endian integers of ``dtype``."""
        if not self.cuts:
            return self._whole(texts)
        odd = ["\0" in text or bool(_UNSAFE.search(text)) or any(s in text for s in self.special) for text in texts]
        whole = [text for text, x in zip(texts, odd, strict=True) if x]
        cut = [self._cut(text) for text, x in zip(texts, odd, strict=True) if not x]
        rest, found = iter(self._whole(whole) if whole else []), iter(joined(cut, "\0", self._found))
        return [next(rest if x else found) for x in odd]


def slices(texts: list[str], chars: int = 2_000_000):
    """Runs of consecutive texts with about so many characters, so that what a step holds is bounded."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held
