"""BPE ids by one pass of dynamic programming over the prefixes of each word.

A sequence of tokens is what the merges give if, and only if, each neighbouring pair is: that is, if encoding the two tokens' joint
text gives the two tokens back. So every prefix of a word has one possible last token: the one that ends there, whose rest is a
prefix that has been solved, and that is compatible with that prefix's own last token. An Aho-Corasick automaton over the vocabulary
(the suffix automaton of all tokens, with its suffix links) gives the tokens that end at each place, and back-pointers from the word's
end give the ids. Words are cached in each Python worker up to a number of bytes.

Defined results: null text is empty: no ids and an empty decoded text; repeated rows give repeated rows; null doc_ids stay null; an
empty table gives an empty table; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldloom.llm.common import text_of
from fieldloom.llm.token_ids import Pieces, slices

#: Ends a word inside the automaton; no token has it, as byte-level tokens have no control characters.
END = "\0"
#: Bytes of words and what they give that one Python worker keeps.
CACHED_BYTES = 200_000_000
#: In texts without any of these, white space and lower case are the same for Python as for the tokenizer's normaliser.
_ODD = re.compile(r"[^\t-\r -įı-ɏ]")

_models: dict[str, PrefixBpe] = {}


def model(path: str) -> PrefixBpe:
    if path not in _models:
        _models[path] = PrefixBpe(path)
    return _models[path]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, k = {b: chr(b) for b in printed}, 0
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + k)
            k += 1
    return [shown[b] for b in range(256)]


class PrefixBpe:
    def __init__(self, path: str, cached: int = CACHED_BYTES):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe = spec["model"]
        self.suffix = bpe.get("end_of_word_suffix") or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.tokens = {i: t for t, i in bpe["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = {self.inner(t): i for t, i in bpe["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        self.rank = {(self.inner(a), self.inner(b)): k for k, (a, b) in enumerate(merges)}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for (a, b), k in self.rank.items():
            self.parts.setdefault(a + b, (a, b, k))
        late = next((a + b for (a, b), k in self.rank.items() for x in (a, b) if self.parts.get(x, ("", "", -1))[2] > k), None)
        if late:
            raise ValueError(f"a part of {late!r} is merged after it: pairs don't decide such a vocabulary")
        self.whole: dict[str, bool] = {}
        # What the automaton gives: id, text, length and, for each id that has stood before it, whether it may.
        self.automaton = ahocorasick.Automaton()
        self.text = [""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.text[i] = token
            if self.real(token):
                self.automaton.add_word(token, (i, token, len(token), {}))
        self.automaton.make_automaton()
        self.words = Pieces(self._chunk, cached)

    def inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def _ends(self, token: str, side: int) -> list[tuple[str, float]]:
        """The token, its right (1) or left (0) part, that part's, and so on, each with the rank at which it is merged away."""
        out, gone = [(token, float("inf"))], float("inf")
        while token in self.parts:
            gone, token = self.parts[token][2], self.parts[token][side]
            out.append((token, gone))
        return out

    def compatible(self, left: str, right: str) -> bool:
        """No merge across the border comes before both its sides are merged away; at equal ranks the leftmost is merged first."""
        rights = self._ends(right, 0)
        for a, a_gone in self._ends(left, 1):
            for b, b_gone in rights:
                k = self.rank.get((a, b))
                if k is not None and k < a_gone and k <= b_gone:
                    return False
        return True

    def real(self, token: str) -> bool:
        """Whether the token's own text gives the token."""
        known = self.whole.get(token)
        if known is None:
            if token in self.parts:
                a, b, _ = self.parts[token]
                known = self.real(a) and self.real(b) and not self.compatible(a, b)
            else:
                known = len(token.rstrip(END)) == 1
            self.whole[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte symbols."""
        text = word + END if self.suffix else word
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        for at, (i, token, size, may) in self.automaton.iter(text):
            at += 1
            if last[at] is None:
                if at > size:
                    before = last[at - size]
                    if before is None:
                        continue
                    known = may.get(before)
                    if known is None:
                        known = may[before] = self.compatible(self.text[before], token)
                    if not known:
                        continue
                last[at] = i
        out = []
        while n:
            out.append(last[n])
            n -= len(self.text[last[n]])
        return out[::-1]

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Count, decimal ids and tokens of what stands between white space."""
        if chunk.isascii() and chunk.isalpha():
            ids = self.encode_word(chunk)
        else:
            ids = []
            for word in self.pattern.findall(chunk):
                ids += self.encode_word(word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode())))
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def _segment(self, text: str) -> list[tuple[int, str, str]]:
        if _ODD.search(text):
            chunks = self.normalizer.normalize_str(text).split(" ")
        else:
            chunks = text.lower().split()
        return list(map(self.words.__getitem__, chunks))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Count of ids, the ids in decimal and the decoded text: tokens, each with one space between them and the next."""
        if self.split_special and any(s in text for s in self.special):
            found = []
            for part in self.split_special.split(text):
                if part in self.special:
                    found.append((1, str(self.special[part]), part))
                elif part:
                    found += self._segment(part)
        else:
            found = self._segment(text)
        found = [x for x in found if x[0]]
        if not found:
            return 0, "", ""
        counts, ids, tokens = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(tokens)


def encode_documents(docs: DataFrame, tokenizer_path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and with ``texts`` the ids (decimal) and the decoded text themselves."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model(tokenizer_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for some in slices(batch.column(1).to_pylist()):
                rows = [(n, sha(ids), sha(decoded)) + ((ids, decoded) if texts else ()) for n, ids, decoded in map(code.encode, some)]
                columns = [pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(some)).cast(pa.int64()), *columns], names)
                at += len(some)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
