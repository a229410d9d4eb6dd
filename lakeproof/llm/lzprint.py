"""Lempel-Ziv phrase fingerprints: a text's LZ78 dictionary phrases, min-hashed.

The parse runs over the UTF-8 bytes of the whole text. Every phrase gets a 64-bit hash and the phrase set is reduced to one minimum per bin (one-permutation hashing, empty bins filled from the next).
The share of equal bins estimates the Jaccard likeness of two phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BINS = 64
#: Kept bits of each minimum; two unequal minima agree in them once in 65,536 times.
KEPT_BITS = 16


class Parser:
    """LZ78 parse of a growing byte string; copies continue independently.

    Nodes are numbered as phrases are found; a key of children is the parent's number above the next byte. ends has the byte
    position behind each phrase; an unfinished last phrase is already in the dictionary and adds nothing.
    """

    def __init__(self) -> None:
        self.children: dict[int, int] = {}
        self.node, self.size, self.ends = 0, 0, []

    def copy(self) -> Parser:
        other = Parser()
        other.children, other.node, other.size, other.ends = self.children.copy(), self.node, self.size, self.ends.copy()
        return other

    def feed(self, data: bytes) -> Parser:
        children, node, count, found = self.children, self.node, len(self.children) + 1, self.ends.append
        get = children.get
        for at, byte in enumerate(data, self.size + 1):
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                children[key] = count
                count += 1
                found(at)
        self.node, self.size = node, self.size + len(data)
        return self


#: An odd number and its inverse modulo 2 ** 64: a phrase's hash is its polynomial in BASE, whatever its place in the text.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    if _powers[base].size <= n:
        _powers[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(2 * n, 1 << 14), base, np.uint64))))
    return _powers[base][: n + 1]


def phrase_hashes(data: bytes, ends: list[int]) -> np.ndarray:
    """Hashes of the phrases of data that end at ends."""
    stops = np.array(ends, np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), stops[:-1])) if stops.size else stops
    terms = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data))[:-1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return _mix((sums[stops] - sums[starts]) * _power(INVERSE, len(data))[starts])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Minimum of each bin, cut to KEPT_BITS; an empty bin takes the next filled one's, changed by its distance."""
    if not hashes.size:
        return np.zeros(bins, np.uint16)
    at = (hashes >> np.uint64(58)).astype(np.int64) % bins
    low = hashes & np.uint64((1 << 58) - 1)
    order = np.argsort(at, kind="stable")
    at, low = at[order], low[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled, least = at[starts], np.minimum.reduceat(low, starts)
    source = np.searchsorted(filled, np.arange(bins)) % filled.size
    distance = (filled[source] - np.arange(bins)) % bins
    return (_mix(least[source] + distance.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_of(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> tuple[str, str]:
    """(kept front, new end): the last half of the code points gives way to as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


class Started:
    """A document with its own fingerprint, whose parse of the kept front waits for the following text."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.front = edited(text, "")[0]
        self.parser = Parser().feed(_bytes(self.front))
        whole = self.parser.copy().feed(_bytes(text[len(self.front) :]))
        self.signature = signature(phrase_hashes(_bytes(text), whole.ends))

    def row(self, following: Started) -> tuple:
        """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
        end = edited(self.text, following.text)[1]
        changed = _bytes(self.front + end)
        other = signature(phrase_hashes(changed, self.parser.copy().feed(_bytes(end)).ends))
        sha = hashlib.sha256(changed).hexdigest()
        near = likeness(self.signature, other), likeness(self.signature, following.signature)
        return self.doc_id, len(self.text), sha, text_of(self.signature), text_of(other), *near


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STATE = RESULT + ", part long, role string, text string"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """One RESULT row for each row of docs (doc_id, text), compared with the next row in ascending doc_id; the last with the first.

    Null texts are empty and null ids come first; repeated ids are ordered by a hash of their text, so repeated rows agree. A
    single row follows itself. One range shuffle brings neighbours together; each task's first and last rows come back with
    their texts and are matched across tasks by a join, two rows per task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _STATE.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
        blank = (None,) * 6

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * len(types), types)], names=names)

        before = None
        for b in batches:
            found = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                now = Started(doc_id, text.as_py())
                if before is None:
                    found.append((doc_id, *blank, part, "first", now.text))
                else:
                    found.append((*before.row(now), part, "done", None))
                before = now
            yield out(found)
        if before is not None:
            yield out([(before.doc_id, *blank, part, "last", before.text)])

    state = materialize(ordered.mapInArrow(run, _STATE), "lz-state")
    done = state.filter("role = 'done'").select(*[x.split()[0] for x in RESULT.split(", ")])
    # the task whose first row follows a task's last row: the next task with rows, after the last the first
    firsts = state.filter("role = 'first'").select("part")
    following = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy()))
    after = materialize(firsts.select(F.col("part").alias("mine"), following.alias("theirs")), "lz-after")
    heads = state.filter("role = 'first'").select(F.col("part").alias("theirs"), F.col("text").alias("following"))
    tails = state.filter("role = 'last'").select("doc_id", "text", F.col("part").alias("mine"))
    edge = tails.join(after, "mine").join(heads, "theirs").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Started(i, text).row(Started(None, following)) for i, text, following in zip(*(b.column(k).to_pylist() for k in range(3)))]
            names = [x.split()[0] for x in RESULT.split(", ")]
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * len(types), types)], names=names)

    return done.unionByName(edge.mapInArrow(finish, RESULT))

