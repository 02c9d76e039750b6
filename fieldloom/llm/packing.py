"""Packing of token ids into windows by the online sum-of-squares rule.

Each document's ids and an end id are cut at multiples of the window; its last piece goes, as it arrives, to the fill level that
makes the sum of squares of the counts of partly filled windows smallest (an array with a count for each level; ties go to the
fullest). Each task packs the rows it reads, so nothing is shuffled. Where no two pieces fit together, windows would stay open without
end; beyond ``OPEN_PER_LEVEL`` open windows for each level, the pieces of the level that has most are strung together and cut anew at
the window, which leaves at most one of them open. The same is done at a task's end with all that is still open, where what remains
is cut into powers of two, which need no padding.

Defined results: null text is empty (its one id is the end id); repeated rows and doc_ids are packed each for itself; null doc_ids
stay null; an empty table gives an empty table; texts of any length are packed whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldloom.llm.common import text_of
from fieldloom.llm.token_ids import encoder, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Open windows, on average over the levels, that a task holds: 4,096 of them, and 8 MB of ids, for windows of 1024 small ids.
OPEN_PER_LEVEL = 4


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens). ``done`` gets (piece, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.window, self.sequence, self.done = window, first_sequence, []
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((piece, self.sequence, offset))
            offset += len(piece[2])
        self.sequence += 1

    def document(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.close([(doc_id, at, ids[at : at + self.window], n)])
        if n > whole:
            # A copy, so that an open window doesn't hold all ids of a long document.
            self.place((doc_id, whole, ids[whole:].copy() if whole else ids, n))
            if self.n_open > OPEN_PER_LEVEL * self.window:
                self.thin()

    def place(self, piece: tuple) -> None:
        """Change of the sum of squares: a level that loses a window gives 1 - 2 N, one that gains one gives 2 N + 1; an empty
        and a full window count nothing."""
        size, count = len(piece[2]), self.count
        room = self.window - size
        levels = np.flatnonzero(count[: room + 1])  # level 0 is never counted
        change = 2 * count[levels + size] + 1 - 2 * count[levels] + 1
        if len(levels) and levels[-1] == room:
            change[-1] = 1 - 2 * count[room]
        best = len(levels) - 1 - int(np.argmin(change[::-1])) if len(levels) else -1
        if best >= 0 and change[best] <= 2 * count[size] + 1:
            level = int(levels[best])
            count[level] -= 1
            held = self.open[level].pop()
            self.n_open -= 1
        else:
            level, held = 0, []
        held.append(piece)
        if level + size == self.window:
            self.close(held)
        else:
            self.keep(held, level + size)

    def keep(self, held: list, level: int) -> None:
        self.open[level].append(held)
        self.count[level] += 1
        self.n_open += 1

    def take(self, level: int) -> list:
        """The pieces of a level's open windows, which are open no more."""
        pieces = [p for held in self.open[level] for p in held]
        self.n_open -= len(self.open[level])
        self.open[level], self.count[level] = [], 0
        return pieces

    def strung(self, pieces: list, last: bool) -> tuple[list, int]:
        """Cuts pieces, strung together, at the window; with ``last`` the rest in powers of two, else the rest and its size are returned."""
        left = sum(len(p[2]) for p in pieces)
        held, size, most = [], 0, 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                if not held:
                    most = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1)
                part = ids[: most - size]
                held.append((doc_id, start, part, n))
                start, ids, size, left = start + len(part), ids[len(part) :], size + len(part), left - len(part)
                if size == most:
                    self.close(held)
                    held, size = [], 0
        return held, size

    def thin(self) -> None:
        """The level with most open windows (it has two or more, as there are more windows than levels) keeps none; one, of the rest, may open."""
        held, size = self.strung(self.take(int(np.argmax(self.count))), last=False)
        if held:
            self.keep(held, size)

    def drain(self) -> None:
        """All that is open, level by level from the top."""
        self.strung([p for level in range(self.window, -1, -1) for p in self.take(level)], last=True)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece, as in ``SCHEMA``; sequence ids are unique, with the number of the task in the upper bits."""

    def rows(done: list) -> pa.RecordBatch:
        columns = [
            pa.array([p[0] for p, _, _ in done], pa.int64()),
            pa.array([p[1] for p, _, _ in done], pa.int64()),
            pa.array([len(p[2]) for p, _, _ in done], pa.int64()),
            pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p, _, _ in done], pa.int64()),
            pa.array([p[3] for p, _, _ in done], pa.int64()),
            pa.array([s for _, s, _ in done], pa.int64()),
            pa.array([o for _, _, o in done], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path)
        end = np.array([end_id], dtype=code.dtype).tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for some in slices(batch.column(1).to_pylist()):
                for packed in code.encode(some):
                    packer.document(names[at], np.frombuffer(packed + end, dtype=code.dtype))
                    at += 1
                yield rows(packer.done)
                packer.done = []
        packer.drain()
        yield rows(packer.done)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)
