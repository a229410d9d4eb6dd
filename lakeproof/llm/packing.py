"""Sum-of-squares online packing of documents into token windows.

A document's whole windows are cut off its front; the rest goes to the fill level that keeps the sum of squared counts of
partly filled windows smallest. The levels are an array of counts per task; tasks pack their own input split, so nothing is
shuffled and a lost task is simply packed again. At the end of a split the emptiest open windows are cut up to fill the gaps
of the fullest, which keep what was placed in them; the rest, below one window, is split into powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

WINDOW = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Places items below the window size. Level h counts the open windows that hold h tokens."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.items: dict[int, list[tuple]] = {}
        self.made = 0

    def new_window(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int, bool]:
        """(window, offset, full) for an item of 1 to window - 1 tokens; of equal choices, the fullest window."""
        n = self.counts
        # moving a window from level h to h + size changes the sum of squares by 2 * (n[h + size] - n[h]) + 2
        levels = np.arange(1, self.window - size + 1)
        change = 2 * (n[levels + size] - n[levels]) + 2
        if levels.size:
            change[-1] = 1 - 2 * n[self.window - size]
            change[n[levels] == 0] = np.iinfo(np.int64).max
        best = levels.size - 1 - int(np.argmin(change[::-1])) if levels.size else -1
        if best < 0 or change[best] > 2 * n[size] + 1:
            at, level = self.new_window(), 0
        else:
            level = int(levels[best])
            at = self.open[level].pop()
            n[level] -= 1
        if level + size < self.window:
            n[level + size] += 1
            self.open[level + size].append(at)
        return at, level, level + size == self.window


def powers(length: int) -> list[int]:
    """The powers of two, descending, that sum to length."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packing:
    """The pieces of one input split; yields rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.packer = window, LevelPacker(window)
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        total, w = len(ids), self.window
        whole = total - total % w
        for start in range(0, whole, w):
            yield doc_id, start, w, zlib.crc32(ids[start : start + w].tobytes()), total, self.packer.new_window(), 0
        if total > whole:
            at, offset, full = self.packer.place(total - whole)
            self.held.setdefault(at, []).append((doc_id, whole, ids[whole:].copy(), total, offset))
            if full:
                for d, start, part, n, off in self.held.pop(at):
                    yield d, start, len(part), zlib.crc32(part.tobytes()), n, at, off

    def flush(self) -> Iterator[tuple]:
        """Fills the open windows, fullest first, with pieces of the emptiest; what is left of those is cut into powers of two.

        A window that is filled keeps all that the level array placed in it.
        """
        open_ = deque(sorted(self.held.items(), key=lambda x: -sum(len(p[2]) for p in x[1])))
        spare: deque[tuple] = deque()

        def give(room: int, at: int, offset: int) -> Iterator[tuple]:
            while room and spare:
                doc_id, start, ids, total = spare.popleft()
                n = min(room, len(ids))
                yield doc_id, start, n, zlib.crc32(ids[:n].tobytes()), total, at, offset
                room, offset = room - n, offset + n
                if n < len(ids):
                    spare.appendleft((doc_id, start + n, ids[n:], total))

        loose = 0
        while open_:
            at, parts = open_.popleft()
            fill = sum(len(p[2]) for p in parts)
            while open_ and loose < self.window - fill:
                spare.extend(p[:4] for p in open_.pop()[1])
                loose = sum(len(p[2]) for p in spare)
            if loose < self.window - fill:
                spare.extendleft(p[:4] for p in reversed(parts))
                break
            for doc_id, start, ids, total, offset in parts:
                yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, at, offset
            yield from give(self.window - fill, at, fill)
            loose -= self.window - fill
        left = sum(len(p[2]) for p in spare)
        for size in [self.window] * (left // self.window) + powers(left % self.window):
            yield from give(size, self.packer.new_window(), 0)
        self.held.clear()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each document (doc_id, text).

    A null or empty text is the single end id. Repeated rows are packed once each. doc_id may be null. sequence_id is the
    number of the input split above 40 bits of a count; it and offset depend on how the input is split, the ids do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packing = Encoder(tokenizer).encode, Packing(window)
        base = TaskContext.get().partitionId() << 40

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns]
            arrays[5] = pa.array([base + x for x in columns[5]], pa.int64())
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = np.array([END_ID], "<u4")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packing.add(doc_id, np.concatenate((encode(text.as_py() or ""), end)))
            yield out(rows)
        yield out(list(packing.flush()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)
