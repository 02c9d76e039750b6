"""Token ids on disk as one wavelet matrix per shard.

``write_shards`` ranges the documents by doc_id, encodes every whole text, appends the end id and writes shards of about
``shard_tokens`` ids, each one compressed file image (``WaveletMatrix.pack``) in a row of a Parquet table, as Spark can write
to any store. ``read_documents`` reads them back. A shard answers, from its own bytes: the id at a place (``access``), how often
an id occurs before a place (``rank``) and where its k-th occurrence is (``select``). Its planes are cut into blocks, each a compressed
frame of its own, and a directory tells where each frame lies and how many ones stand before it, so an answer inflates a block for each
plane that it passes, not the shard. ``token_counts``, ``occurrences`` and ``tokens_at`` ask all shards as Spark jobs.

Image: ``MAGIC``, the length of the documents' frame, their ids and lengths as one frame, then the matrix: number of ids and of planes,
ones before each block of each plane, end of each frame, the frames. Integers are little-endian.

Defined results: null text is empty (its only id is the end id); null doc_ids come first; rows of equal doc_id stand in the order
of their texts, repeated rows each keep their own ids;
an empty table gives an empty table; a text longer than a shard has a shard of its own, whole; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import staged, text_of
from fieldloom.llm.token_ids import encoder, slices

MAGIC = b"WMX2"
#: Bits of a block: from one count of ones to the next, and in one frame.
BLOCK = 1 << 17
#: Blocks that an open image keeps inflated.
HELD_BLOCKS = 64
#: Ids that are dealt to the zeros and ones of a plane at once: their places stay in the processor's cache.
DEALT = 1 << 16
SHARD_TOKENS = 1 << 20


def dealt(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """Runs of a plane, each twice: the run, the places in it of one kind of bit, and where the next plane has those, ``zeros`` zeros before
    all ones. Places cost the same however the bits mix; a mask takes several times as long where zeros and ones alternate."""
    ends = [0, zeros]
    for at in range(0, len(one), DEALT):
        run = slice(at, at + DEALT)
        for kind, bits in enumerate((~one[run], one[run])):
            places = np.flatnonzero(bits)
            begin, ends[kind] = ends[kind], ends[kind] + len(places)
            yield run, places, slice(begin, ends[kind])


class WaveletMatrix:
    """Bit-planes of a sequence of ids, from the highest bit down. In each next plane, the ids whose bit is 0 come before the
    others, both in their order before. ``ones`` has the count of ones ahead of each block of ``BLOCK`` bits."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes, self.width = n, planes, len(planes)
        self.ones = np.zeros((self.width, self.blocks + 1), dtype=np.int64)
        for level in range(self.width):
            for b in range(self.blocks):
                self.ones[level, b + 1] = self.ones[level, b] + int(np.bitwise_count(self._block(level, b)).sum())
        self.zeros = (n - self.ones[:, -1]).tolist()

    @property
    def blocks(self) -> int:
        return -(-self.n // BLOCK)

    def _block(self, level: int, b: int) -> np.ndarray:
        """The bytes of one block of a plane."""
        return self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8]

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        width = width or max(1, int(ids.max(initial=0)).bit_length())
        planes, left = [], ids
        for bit in range(width - 1, -1, -1):
            one = (left & left.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            if bit:
                parted = np.empty_like(left)
                for run, places, there in dealt(one, len(one) - int(np.count_nonzero(one))):
                    parted[there] = left[run].take(places)
                left = parted
        return cls(len(ids), planes)

    def _rank1(self, level: int, i: int) -> int:
        """How many ones the plane has before place i."""
        b, rest = i // BLOCK, i % BLOCK
        found = int(self.ones[level, b])
        if rest:
            held = self._block(level, b)
            found += int(np.bitwise_count(held[: rest // 8]).sum())
            if rest % 8:
                found += (int(held[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return found

    def _select(self, level: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) bit of this kind."""
        ahead = self.ones[level] if one else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ones[level]
        b = int(np.searchsorted(ahead, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, b), bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == one)[k - int(ahead[b])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.width):
            ones = self._rank1(level, i)
            bit = self._block(level, i // BLOCK)[i % BLOCK // 8] >> (i % 8) & 1
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _narrow(self, value: int, i: int) -> tuple[int, int]:
        """Where the run of this id begins below the last plane, and how many of the first i ids are in it."""
        if value >> self.width:
            return 0, 0
        begin, end = 0, i
        for level in range(self.width):
            a, b = self._rank1(level, begin), self._rank1(level, end)
            if value >> (self.width - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end - begin

    def rank(self, value: int, i: int) -> int:
        return self._narrow(value, i)[1]

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        begin, n = self._narrow(value, self.n)
        if not 0 <= k < n:
            return -1
        at = begin + k
        for level in range(self.width - 1, -1, -1):
            one = bool(value >> (self.width - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """Every id in order: from the last plane up, each plane deals the ids back to where they stood."""
        kind = np.dtype("<u2") if self.width <= 16 else np.dtype("<u4")
        held = np.zeros(self.n, dtype=kind)
        for bit, level in enumerate(reversed(range(self.width))):
            plane = np.concatenate([self._block(level, b) for b in range(self.blocks)] or [np.zeros(0, dtype=np.uint8)])
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            held[zeros:] |= kind.type(1 << bit)
            back = np.empty_like(held)
            for run, places, there in dealt(one, zeros):
                back[run][places] = held[there]
            held = back
        return held

    def pack(self) -> bytes:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=1)
        frames = [pressed.compress(self._block(level, b).tobytes()) for level in range(self.width) for b in range(self.blocks)]
        ends = np.cumsum([len(f) for f in frames], dtype="<u8")
        return struct.pack("<QB", self.n, self.width) + self.ones.astype("<u4").tobytes() + ends.tobytes() + b"".join(frames)


class StoredMatrix(WaveletMatrix):
    """A wavelet matrix that answers from the bytes of ``pack``; it inflates the blocks that it needs and keeps some."""

    def __init__(self, data: memoryview | bytes):
        import zstandard

        self.data, self.inflate, self.held = memoryview(data), zstandard.ZstdDecompressor(), {}
        self.n, self.width = struct.unpack_from("<QB", self.data)
        at, count = struct.calcsize("<QB"), self.width * (self.blocks + 1)
        self.ones = np.frombuffer(self.data, dtype="<u4", count=count, offset=at).reshape(self.width, -1).astype(np.int64)
        at += 4 * count
        self.ends = np.frombuffer(self.data, dtype="<u8", count=self.width * self.blocks, offset=at).tolist()
        self.begin = at + 8 * len(self.ends)
        self.zeros = (self.n - self.ones[:, -1]).tolist()

    def _block(self, level: int, b: int) -> np.ndarray:
        k = level * self.blocks + b
        found = self.held.pop(k, None)
        if found is None:
            begin = self.begin + (self.ends[k - 1] if k else 0)
            found = np.frombuffer(self.inflate.decompress(self.data[begin : self.begin + self.ends[k]]), dtype=np.uint8)
        self.held[k] = found
        if len(self.held) > HELD_BLOCKS:
            del self.held[next(iter(self.held))]
        return found


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    import zstandard

    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    head = struct.pack("<Q", len(doc_ids)) + known.tobytes()
    head += np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes()
    head = zstandard.ZstdCompressor(level=1).compress(head)
    return MAGIC + struct.pack("<Q", len(head)) + head + WaveletMatrix.build(ids, width).pack()


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, StoredMatrix]:
    """doc_ids, lengths, matrix."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    (size,) = struct.unpack_from("<Q", data, 4)
    raw = zstandard.ZstdDecompressor().decompress(data[12 : 12 + size])
    (n,) = struct.unpack_from("<Q", raw)
    known = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8).tolist()
    numbers = np.frombuffer(raw, dtype="<i8", count=2 * n, offset=8 + n)
    docs = [d if k else None for d, k in zip(numbers[:n].tolist(), known, strict=True)]
    return docs, numbers[n:], StoredMatrix(memoryview(data)[12 + size :])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shards (part, shard, n_docs, n_tokens, image), written and read back. Ordered by (part, shard), it has the
    documents in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path)
        part, shard = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=code.dtype).tobytes()
        width = max(code.size - 1, end_id).bit_length()
        docs_held, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=code.dtype)
            image = pack_shard(docs_held, lengths, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "image"])

        for batch in batches:
            names, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in slices(texts):
                for packed in code.encode(some):
                    n = len(packed) // code.dtype.itemsize + 1
                    if size and size + n > shard_tokens:
                        yield flush()
                        docs_held, lengths, held, size, shard = [], [], [], 0, shard + 1
                    docs_held.append(names[at])
                    lengths.append(n)
                    held += (packed, end)
                    size, at = size + n, at + 1
        if size:
            yield flush()

    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(rows.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, image binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document from the shard images: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, lengths, matrix = open_shard(row["image"])
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "image").mapInArrow(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # The sums run over shards of one part, and over parts: few rows each.
    sizes = shards.groupBy("part", "shard").agg(F.sum("n_tokens").alias("shard_size"))
    ahead = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "shard", F.coalesce(F.sum("shard_size").over(ahead), F.lit(0)).alias("in_part"))
    parts = sizes.groupBy("part").agg(F.sum("shard_size").alias("part_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("before_part"))
    base = inside.join(parts, "part").select("part", "shard", (F.col("in_part") + F.col("before_part")).alias("base"))
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _asked(shards: DataFrame, schema: str, answer) -> DataFrame:
    """Rows of ``answer(row, docs, ends, matrix)`` for each shard; the shard's other columns come as they are."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, matrix = open_shard(row["image"])
                found = answer(row, docs, np.cumsum(lengths), matrix)
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=_ARROW[schema])

    return shards.mapInArrow(run, schema)


COUNTS, PLACES, TOKENS = "part int, shard int, n long", "doc_id long, place long", "doc_id long, place long, token long"
_ARROW = {
    COUNTS: pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]),
    PLACES: pa.schema([("doc_id", pa.int64()), ("place", pa.int64())]),
    TOKENS: pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("token", pa.int64())]),
}


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """part, shard, n: how often the id occurs, by one rank at the end of each shard."""
    return _asked(shards, COUNTS, lambda row, docs, ends, matrix: [(row["part"], row["shard"], matrix.count(token))])


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place (from 0, in the document) of every occurrence of the id, by select."""
    def answer(row, docs, ends, matrix):
        for at in matrix.occurrences(token):
            k = int(np.searchsorted(ends, at, side="right"))
            yield docs[k], at - (int(ends[k - 1]) if k else 0)

    return _asked(shards, PLACES, answer)


def tokens_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, place, token of the wanted (doc_id, place) that exist, by access. Documents of a shard come from the shard's own list, so the
    wanted are joined with shards by doc_id, and each shard is opened once."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, _, _ = open_shard(row["image"])
                known = [d for d in dict.fromkeys(docs) if d is not None]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(known), pa.int32()), pa.array([row["shard"]] * len(known), pa.int32()), pa.array(known, pa.int64())], ["part", "shard", "doc_id"])

    where = shards.mapInArrow(listed, "part int, shard int, doc_id long")
    asked = wanted.select("doc_id", "place").distinct().join(where, "doc_id").groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "place")).alias("asked"))

    def answer(row, docs, ends, matrix):
        first = {d: k for k, d in reversed(list(enumerate(docs)))}
        for x in row["asked"]:
            k = first[x["doc_id"]]
            begin = int(ends[k - 1]) if k else 0
            if 0 <= x["place"] < int(ends[k]) - begin:
                yield x["doc_id"], x["place"], matrix.access(begin + x["place"])

    return _asked(shards.join(asked, ["part", "shard"]).select("image", "asked"), TOKENS, answer)
