"""Scoring by a hierarchical Pitman-Yor bigram model.

Every word is the context restaurant of the words after it; all context restaurants share the root restaurant as their parent.
Seating is the number of tables per dish. A Gibbs sweep draws the tables of all dishes of the contexts from their conditional
given the other tables of their context and the root's predictive (generalised Stirling numbers), then those of the root given
the tables of all contexts, which are its customers. The predictive probabilities of the states after the first few sweeps
are averaged.

The corpus is cut into blocks of local word numbers. Per block, counts are summed before they are dealt out to buckets of words
or of word pairs, packed as one row for each block and bucket. A pair bucket keeps the customers and tables of its dishes from
sweep to sweep; it tells word buckets how many tables each of its words has, and gets the root's share of the word back. After
the last sweep it sends the averaged probabilities that a block asked for, in the block's own order. No model is collected or
broadcast: it stays dealt out, and grows with the corpus. Contexts with over half a bucket's share of tokens are dealt by pair,
so no bucket depends on the frequency of one word; between sweeps their tables are summed over all buckets (one number for each
such context and bucket; there are at most twice as many such contexts as buckets). Every pass is written to the shared folder.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Ids and local numbers of the end token and of the start of a text, which is only a context. Words are known by 48 bits of
#: their hash; ids of a block are sorted, so these two are the first.
END, START = 0, 1
MARKS = np.array([1, 2], np.uint64)
ID_SHIFT = 16
PACKET = "block long, kind int, bucket int, x double, y double, a binary, b binary, c binary, d binary, e binary, f binary"
TEXT, ASK_WORDS, WORDS, WORD_SUMS, ASK_PAIRS, DISHES, ORDER, TABLES, WIDE, ASK_ROOT, ROOT, ROOT_SUMS, SAMPLE, PAIRS = range(14)


@dataclass(frozen=True)
class Settings:
    """discount and strength of the contexts and of the root; sweeps, of which the first burn_in are not averaged; tokens of
    a block at most, but for a longer text; spread: buckets that a frequent context's pairs are dealt to; bucket_tokens:
    training tokens for each pair bucket, about, above one bucket for each of the session's partitions; root_words: different
    words for each bucket of the root, about, up to one bucket for each partition (few, as all pair buckets write to each)."""

    discount: float = 0.8
    strength: float = 1.0
    root_discount: float = 0.6
    root_strength: float = 10.0
    sweeps: int = 6
    burn_in: int = 3
    block_tokens: int = 2_000_000
    spread: int = 64
    bucket_tokens: int = 4_000_000
    root_words: int = 100_000
    seed: int = 1


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


# ---- seating ---------------------------------------------------------------------------------------------------------

#: Customers up to which a dish's tables are drawn from the conditional itself.
EXACT = 512
#: Numbers held at a time by a draw.
CELLS = 1 << 21


def stirling(discount: float, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """log S(c, t) for t = 1..c, for each wanted c: generalised Stirling numbers, S(c+1, t) = S(c, t-1) + (c - t * discount) * S(c, t)."""
    out, row = {}, np.array([0.0])
    ask = set(wanted.tolist())
    for c in range(1, max(ask, default=0) + 1):
        if c > 1:
            t = np.arange(1, c)
            with np.errstate(divide="ignore"):
                stay = np.append(np.log(np.maximum(c - 1 - t * discount, 0.0)) + row, -np.inf)
            row = np.logaddexp(stay, np.concatenate(([-np.inf], row)))
        if c in ask:
            out[c] = row
    return out


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers, given the other tables of their restaurant and the parent's probability.

    The conditional is P(t) ~ S(c, t) * parent ** t * product of strength + discount * (others + j), j < t. Up to EXACT
    customers S is tabulated; above it has its limit form, in which S(c, t) * (t - 1)! * discount ** t depends on
    t / c ** discount alone but for a factor, and is read off the last tabulated row.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    order = order[(customers[order] > 1) & (customers[order] <= EXACT)]
    sizes, starts = np.unique(customers[order], return_index=True)
    big = np.flatnonzero(customers > EXACT)
    table = stirling(discount, np.append(sizes, EXACT) if big.size else sizes)
    for c, a, b in zip(sizes.tolist(), starts, [*starts[1:], order.size]):
        step = max(1, CELLS // c)
        for k in range(a, b, step):
            part = order[k : min(b, k + step)]
            w = np.log(strength + discount * (others[part][:, None] + np.arange(c)))
            w += np.log(parent[part])[:, None]
            np.cumsum(w, axis=1, out=w)
            w += table[c]
            w -= w.max(axis=1, keepdims=True)
            w = np.cumsum(np.exp(w, out=w), axis=1, out=w)
            out[part] = 1 + np.minimum((w < rng.random(part.size)[:, None] * w[:, -1:]).sum(axis=1), c - 1)
    if big.size:
        out[big] = _draw_large(customers[big].astype(float), others[big], parent[big], strength, discount, table[EXACT], rng)
    return out


def _draw_large(c: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """draw_tables for dishes of many customers; row: log S(EXACT, t). Draws among the values around the mode."""
    at = np.arange(row.size + 1.0)
    shape = np.append(0.0, row + np.array([math.lgamma(t) for t in at[1:]]) + at[1:] * math.log(discount))
    shape[0] = 2 * shape[1] - shape[2]
    last = shape[-1] - shape[-2]

    def phi(t: np.ndarray) -> np.ndarray:
        return np.interp(t, at, shape) + last * np.maximum(t - row.size, 0.0)

    def climb(t: np.ndarray, others: np.ndarray, log_parent: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """log P(t + 1) - log P(t), which falls with t."""
        return np.log(strength + discount * (others + t)) + log_parent - np.log(discount * t) + phi((t + 1) * scale) - phi(t * scale)

    args = others, np.log(parent), (row.size / c) ** discount
    low, high = np.ones(c.size), c.copy()
    for _ in range(60):
        middle = (low + high) / 2
        up = climb(middle, *args) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    step = np.maximum(1.0, low / 100)
    width = 20 + 10 * np.sqrt(step / np.maximum(climb(low, *args) - climb(low + step, *args), 1e-12))
    out = np.zeros(c.size, np.int64)
    for k in range(c.size):
        t = np.arange(max(1.0, math.floor(low[k] - width[k])), min(c[k], math.ceil(low[k] + width[k])) + 1)
        w = np.append(0.0, np.cumsum(climb(t[:-1], *(x[k] for x in args))))
        w = np.cumsum(np.exp(w - w.max()))
        out[k] = t[np.searchsorted(w, rng.random() * w[-1])]
    return out


def sweep_contexts(c: np.ndarray, t: np.ndarray, context: np.ndarray, parent: np.ndarray, elsewhere: np.ndarray, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, t tables before, in restaurants `context`; elsewhere: a restaurant's tables that are not
    listed here. Dishes of one restaurant are drawn in two halves, the second given the first."""
    t = t.copy()
    many = np.flatnonzero(c > 1)
    half = rng.random(many.size) < 0.5
    for mine in (many[half], many[~half]):
        whole = np.bincount(context, t, minlength=elsewhere.size) + elsewhere
        t[mine] = draw_tables(c[mine], whole[context[mine]] - t[mine], parent[mine], s.strength, s.discount, rng)
    return t


# ---- packets ---------------------------------------------------------------------------------------------------------

NAMES = [x.split()[0] for x in PACKET.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(NAMES), types)], names=NAMES)


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of a number array, the bytes of equal place together: counts and shares are small or repeat."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """An ascending array by its steps."""
    return pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _row(block: int, kind: int, bucket: int = 0, *arrays: bytes, x: float = 0.0, y: float = 0.0) -> tuple:
    return block, kind, bucket, x, y, *arrays, *[b""] * (6 - len(arrays))


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their column `key`, one list for each value."""
    held, now = [], None
    for b in batches:
        for r in zip(*(col.to_pylist() for col in b.columns)):
            if held and r[key] != now:
                yield held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield held


def _out(groups: Iterator[list[tuple]], body: Callable[[list[tuple]], list[tuple]]) -> Iterator[pa.RecordBatch]:
    for g in groups:
        yield _rows(body(g))


def _by_kind(rows: list[tuple], kind: int) -> list[tuple]:
    return [r for r in rows if r[1] == kind]


class Block:
    """A block of texts: sorted vocabulary ids, tokens as places among them, and per text its length, id and part."""

    def __init__(self, row: tuple) -> None:
        self.id = row[0]
        self.vocab, self.tokens = unpack_sorted(row[5]), unpack(row[6], np.uint32)
        self.lengths = unpack(row[7], np.int64)
        n = self.lengths.size
        self.doc_ids = np.frombuffer(row[8][: 8 * n], np.int64)
        flags = np.frombuffer(row[8][8 * n :], np.uint8)
        self.named, self.held_out = (flags & 1).astype(bool), (flags & 2).astype(bool)

    def word_order(self, buckets: int) -> np.ndarray:
        """Local numbers by word bucket, then by id."""
        return np.argsort(_word_bucket(self.vocab, buckets), kind="stable")

    def counts(self, rows: list[tuple], buckets: int) -> np.ndarray:
        """The corpus counts that the word buckets sent, by local number. rows are in order of buckets."""
        out = np.zeros(self.vocab.size, np.int64)
        out[self.word_order(buckets)] = np.concatenate([unpack(r[5], np.int64) for r in rows])
        return out

    def pairs(self, counts: np.ndarray, total: float, buckets: int, s: Settings) -> Pairs:
        contexts = np.empty_like(self.tokens)
        contexts[1:] = self.tokens[:-1]
        contexts[np.concatenate(([0], np.cumsum(self.lengths)[:-1]))] = START
        key, inverse = np.unique(contexts.astype(np.uint64) << np.uint64(32) | self.tokens, return_inverse=True)
        u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = np.bincount(inverse, np.repeat(~self.held_out, self.lengths), minlength=key.size).astype(np.uint32)
        # a context with more than its share of tokens is dealt by pair
        wide = counts * 2.0 * buckets > total
        at = _mix(self.vocab)[u] + np.where(wide[u], _mix(self.vocab + np.uint64(7))[w] % np.uint64(s.spread), np.uint64(0))
        bucket = (at % np.uint64(buckets)).astype(np.int64)
        return Pairs(u, w, n, wide, bucket, np.argsort(bucket, kind="stable"), inverse)


@dataclass
class Pairs:
    """The different (context, word) pairs of a block in local numbers, their training counts and buckets, and their order by
    bucket; wide: by local number, whether a context is dealt by pair; inverse: by token."""

    u: np.ndarray
    w: np.ndarray
    n: np.ndarray
    wide: np.ndarray
    bucket: np.ndarray
    order: np.ndarray
    inverse: np.ndarray


def _word_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(ids + np.uint64(3)) % np.uint64(buckets)).astype(np.int64)


def _slices(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of every bucket that occurs in a sorted array."""
    if sorted_buckets.size:
        starts = np.flatnonzero(np.concatenate(([True], sorted_buckets[1:] != sorted_buckets[:-1])))
        for a, b in zip(starts, [*starts[1:], sorted_buckets.size]):
            yield int(sorted_buckets[a]), slice(a, b)


def _ask_words(sender: int, kind: int, ids: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """A packet for each word bucket: sorted ids and their values."""
    at = _word_bucket(ids, buckets)
    order = np.argsort(at, kind="stable")
    return [_row(sender, kind, k, pack_sorted(ids[order[s]]), pack(values[order[s]])) for k, s in _slices(at[order])]


# ---- passes ----------------------------------------------------------------------------------------------------------

def _cut_blocks(buckets: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0

        def close() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> ID_SHIFT for w in list(number)[2:]), np.uint64, len(number) - 2)
            vocab, place = np.unique(np.concatenate((MARKS, hashes)), return_inverse=True)
            flags = np.array([(i is not None) + 2 * held_out(i) for i in ids], np.uint8)
            meta = np.array([i or 0 for i in ids], np.int64).tobytes() + flags.tobytes()
            text = _row(part + made, TEXT, 0, pack_sorted(vocab), pack(place[np.concatenate(tokens)].astype(np.uint32)), pack(np.array(lengths, np.int64)), meta)
            block = Block(text)
            n = np.bincount(block.tokens[np.repeat(~block.held_out, block.lengths)], minlength=vocab.size)
            n[START] = (~block.held_out).sum()
            return _rows([text, *_ask_words(block.id, ASK_WORDS, vocab, n.astype(np.int64), buckets)])

        def fresh() -> tuple:
            return {b"\n": END, b" ": START}, [], [], []

        number, tokens, lengths, ids = fresh()
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or b"").lower().split()
                put = number.setdefault
                local = [put(w, len(number)) for w in words]
                local.append(END)
                tokens.append(np.array(local, np.uint32))
                lengths.append(len(local))
                ids.append(doc_id)
                held += len(local)
                if held >= s.block_tokens:
                    yield close()
                    made += 1
                    number, tokens, lengths, ids = fresh()
                    held = 0
        if ids:
            yield close()

    return run


def _gather(rows: list[tuple], kind: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different ids of a word bucket's packets, the sums of their values, and each packet's places among the ids."""
    ids = [unpack_sorted(r[5]) for r in rows]
    key, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate([unpack(r[6], kind) for r in rows]), minlength=key.size)
    return key, sums, np.split(inverse, np.cumsum([len(x) for x in ids])[:-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def bucket(rows: list[tuple]) -> list[tuple]:
        key, c, places = _gather(rows, np.int64)
        token = key != MARKS[START]
        out = [_row(r[0], WORDS, r[2], pack(c[at].astype(np.int64))) for r, at in zip(rows, places)]
        return [*out, _row(-1, WORD_SUMS, rows[0][2], x=float(c[token].sum()), y=float((c[token] > 0).sum()))]

    return _out(_groups(batches, 2), bucket)


def _ask_pairs(word_buckets: int, buckets: int, total: float, s: Settings):
    """Packets of a block's pairs for their buckets: contexts with their number of words (and their customers, if dealt by
    pair), words, and by pair the place of its word and its training count."""

    def block(rows: list[tuple]) -> list[tuple]:
        me = Block(rows[0])
        counts = me.counts(rows[1:], word_buckets)
        p = me.pairs(counts, total, buckets, s)
        u, w, n = p.u[p.order], p.w[p.order], p.n[p.order]
        out = []
        for k, part in _slices(p.bucket[p.order]):
            cu, size = np.unique(u[part], return_counts=True)
            cw, place = np.unique(w[part], return_inverse=True)
            customers = np.where(p.wide[cu], counts[cu], 0)
            out.append(_row(me.id, ASK_PAIRS, k, pack_sorted(me.vocab[cu]), pack(size.astype(np.uint32)), pack(customers), pack_sorted(me.vocab[cw]), pack(place.astype(np.uint32)), pack(n[part])))
        return out

    return lambda batches: _out(_groups(batches, 0), block)


class Dishes:
    """The different pairs of a bucket in order of context and word: contexts and words (sorted ids), by dish their places, the
    customers; by context its customers if it is dealt by pair, else 0."""

    def __init__(self, row: tuple) -> None:
        self.contexts, size, self.dealt = unpack_sorted(row[5]), unpack(row[6], np.uint32), unpack(row[7], np.int64)
        self.words, self.w, self.c = unpack_sorted(row[8]), unpack(row[9], np.uint32), unpack(row[10], np.int64)
        self.u = np.repeat(np.arange(self.contexts.size), size)
        self.wide = self.dealt > 0

    def elsewhere(self, t: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Tables that each context has in other buckets, given those of whole contexts (sorted ids, tables)."""
        out = np.zeros(self.contexts.size)
        if self.wide.any():
            here = np.bincount(self.u, t, minlength=self.contexts.size)
            at = np.flatnonzero(self.wide)
            out[at] = totals[1][np.searchsorted(totals[0], self.contexts[at])] - here[at]
        return out

    def tables(self, bucket: int, t: np.ndarray, root_buckets: int) -> list[tuple]:
        """Rows of a state: TABLES by dish, the sum of each WIDE context, and an ASK_ROOT with the tables of each word."""
        sums = np.bincount(self.w, t, minlength=self.words.size).astype(np.uint64)
        at = np.flatnonzero(self.wide)
        here = np.bincount(self.u, t, minlength=self.contexts.size)[at].astype(np.int64)
        out = [_row(-1, TABLES, bucket, pack(t.astype(np.int64)), x=float(t.sum()))]
        if at.size:
            out.append(_row(-1, WIDE, bucket, self.contexts[at].tobytes(), here.tobytes()))
        return out + _ask_words(bucket, ASK_ROOT, self.words, sums, root_buckets)


def _seat_first(root_buckets: int):
    """DISHES of a bucket, the ORDER of each packet's pairs among them, and the state of one table for each dish."""

    def bucket(rows: list[tuple]) -> list[tuple]:
        us, ws = [unpack_sorted(r[5]) for r in rows], [unpack_sorted(r[8]) for r in rows]
        contexts, at_u = np.unique(np.concatenate(us), return_inverse=True)
        words, at_w = np.unique(np.concatenate(ws), return_inverse=True)
        dealt = np.zeros(contexts.size, np.int64)
        dealt[at_u] = np.concatenate([unpack(r[7], np.int64) for r in rows])
        keys, u0, w0 = [], 0, 0
        for r, u, w in zip(rows, us, ws):
            mine = np.repeat(at_u[u0 : u0 + u.size], unpack(r[6], np.uint32))
            keys.append(mine.astype(np.uint64) << np.uint64(32) | at_w[w0 : w0 + w.size][unpack(r[9], np.uint32)].astype(np.uint64))
            u0, w0 = u0 + u.size, w0 + w.size
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([unpack(r[10], np.uint32) for r in rows]), minlength=key.size).astype(np.int64)
        size = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=contexts.size).astype(np.uint32)
        w = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        k = rows[0][2]
        dishes = _row(-1, DISHES, k, pack_sorted(contexts), pack(size), pack(dealt), pack_sorted(words), pack(w), pack(c))
        places = np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])
        # the pairs of a packet are in the order of the dishes
        orders = [_row(r[0], ORDER, k, pack_sorted(x)) for r, x in zip(rows, places)]
        return [dishes, *orders, *Dishes(dishes).tables(k, np.minimum(c, 1), root_buckets)]

    return lambda batches: _out(_groups(batches, 2), bucket)


def _seat_root(tables: float, kinds: float, sweep: int, s: Settings):
    """Seats the words of a bucket at the root, which has so many tables, and sends each asker customers less discounts."""

    def bucket(rows: list[tuple]) -> list[tuple]:
        key, c, places = _gather(rows, np.uint64)
        c = c.astype(np.int64)
        rng = np.random.default_rng([s.seed, rows[0][2], 1, sweep])
        # the root's parent is uniform over the known words and one more
        t = draw_tables(c, np.full(c.size, max(tables - 1.0, 0.0)), np.full(c.size, 1.0 / (kinds + 1.0)), s.root_strength, s.root_discount, rng)
        left = (c - s.root_discount * t).astype(np.float32)
        out = [_row(-1, ROOT, r[0], pack(left[at]), x=float(r[2])) for r, at in zip(rows, places)]
        return [*out, _row(-1, ROOT_SUMS, rows[0][2], x=float(t.sum()))]

    return lambda batches: _out(_groups(batches, 2), bucket)


@dataclass(frozen=True)
class Root:
    """Customers and tables of the root, and the different words of the corpus."""

    customers: float
    tables: float
    kinds: float

    def chance(self, dishes: Dishes, rows: list[tuple], root_buckets: int, s: Settings) -> np.ndarray:
        """The root's predictive probability of each word of a bucket, from the ROOT rows sent to it."""
        left = np.zeros(dishes.words.size)
        order = np.argsort(_word_bucket(dishes.words, root_buckets), kind="stable")
        left[order] = np.concatenate([unpack(r[5], np.float32) for r in sorted(rows, key=lambda r: r[3])])
        return (left + (s.root_strength + s.root_discount * self.tables) / (self.kinds + 1.0)) / (s.root_strength + self.customers)


def _predictive(d: Dishes, t: np.ndarray, elsewhere: np.ndarray, root: np.ndarray, s: Settings) -> np.ndarray:
    """The chance of every dish's word after its context."""
    tables = np.bincount(d.u, t, minlength=d.contexts.size) + elsewhere
    customers = np.where(d.wide, d.dealt, np.bincount(d.u, d.c, minlength=d.contexts.size))
    return (d.c - s.discount * t + (s.strength + s.discount * tables[d.u]) * root[d.w]) / (s.strength + customers[d.u])


def _sweep(root: Root, totals: tuple[np.ndarray, np.ndarray], sweep: int, root_buckets: int, s: Settings):
    """The next state of each bucket; states to be averaged are kept as a SAMPLE: tables by dish, root by word, and by context
    the tables elsewhere."""

    def bucket(rows: list[tuple]) -> list[tuple]:
        k = rows[0][2]
        d, t = Dishes(_by_kind(rows, DISHES)[0]), unpack(_by_kind(rows, TABLES)[0][5], np.int64)
        chance, elsewhere = root.chance(d, _by_kind(rows, ROOT), root_buckets, s), d.elsewhere(t, totals)
        kept = [_row(sweep, SAMPLE, k, pack(t), pack(chance.astype(np.float32)), pack(elsewhere))] if sweep > s.burn_in else []
        t = sweep_contexts(d.c, t, d.u, chance[d.w], elsewhere, s, np.random.default_rng([s.seed, k, 2, sweep]))
        return [*kept, *d.tables(k, t, root_buckets)]

    return lambda batches: _out(_groups(batches, 2), bucket)


def _answer(root: Root, totals: tuple[np.ndarray, np.ndarray], root_buckets: int, s: Settings):
    """PAIRS: the averaged probabilities of each packet's pairs, in its order."""

    def bucket(rows: list[tuple]) -> list[tuple]:
        d, t = Dishes(_by_kind(rows, DISHES)[0]), unpack(_by_kind(rows, TABLES)[0][5], np.int64)
        chance = _predictive(d, t, d.elsewhere(t, totals), root.chance(d, _by_kind(rows, ROOT), root_buckets, s), s)
        kept = _by_kind(rows, SAMPLE)
        for r in kept:
            chance += _predictive(d, unpack(r[5], np.int64), unpack(r[7], np.float64), unpack(r[6], np.float32).astype(np.float64), s)
        chance = (chance / (len(kept) + 1)).astype(np.float32)
        return [_row(r[0], PAIRS, r[2], pack(chance[unpack_sorted(r[5]).astype(np.int64)])) for r in _by_kind(rows, ORDER)]

    return lambda batches: _out(_groups(batches, 2), bucket)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(word_buckets: int, buckets: int, total: float, kinds: float, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            me = Block(rows[0])
            counts = me.counts(_by_kind(rows, WORDS), word_buckets)
            p = me.pairs(counts, total, buckets, s)
            chance = np.ones(p.u.size)
            chance[p.order] = np.concatenate([unpack(r[5], np.float32) for r in _by_kind(rows, PAIRS)])
            starts = np.concatenate(([0], np.cumsum(me.lengths)[:-1]))
            c = counts[me.tokens]
            score = np.add.reduceat(np.log10(chance)[p.inverse], starts)
            base = np.add.reduceat(np.log10((c + 1.0) / (total + kinds + 1.0)), starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            n = me.lengths.size
            columns = [
                pa.array(me.doc_ids, pa.int64(), mask=~me.named), pa.array(me.held_out), pa.array(me.lengths), pa.array(known),
                pa.array(np.full(n, int(total), np.int64)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / me.lengths)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """RESULT for each row of docs (doc_id, text), by a model of the rows that are not held out.

    Null and empty texts are the end token alone. A null doc_id is never held out. Repeated rows count, and are scored, as often
    as they occur. A long text is a block of its own. Without any training text all tokens are equally likely. Samples depend
    on the seed and on the number of buckets: spark.sql.shuffle.partitions, more for corpora of over s.bucket_tokens tokens for
    each of these. perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets = parts
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def to_buckets(rows: DataFrame, body) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(body, PACKET)

    def to_blocks(rows: DataFrame, body, schema: str = PACKET) -> DataFrame:
        return rows.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(body, schema)

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds))

    def sums(rows: DataFrame) -> tuple[float, float]:
        r = rows.agg(F.sum("x"), F.sum("y")).first()
        return r[0] or 0.0, r[1] or 0.0

    cut = materialize(source.mapInArrow(_cut_blocks(word_buckets, s), PACKET), "lm-blocks", "kind")
    counted = materialize(to_buckets(of(cut, ASK_WORDS), _count_words), "lm-words", "kind")
    total, kinds = sums(of(counted, WORD_SUMS))
    discard(cut, f"/kind={ASK_WORDS}")
    buckets, root_buckets = max(parts, round(total / s.bucket_tokens)), min(parts, 1 + int(kinds / s.root_words))
    texts = of(cut, TEXT).unionAll(of(counted, WORDS))

    asked = to_blocks(texts, _ask_pairs(word_buckets, buckets, total, s))
    first = materialize(to_buckets(asked, _seat_first(root_buckets)), "lm-dishes", "kind")
    state, samples, root_tables = first, [], kinds
    for sweep in range(s.sweeps + 1):
        customers = sums(of(state, TABLES))[0]
        seated = materialize(to_buckets(of(state, ASK_ROOT), _seat_root(root_tables, kinds, sweep, s)), "lm-root", "kind")
        root_tables = sums(of(seated, ROOT_SUMS))[0]
        root, totals = Root(customers, root_tables, kinds), _wide_totals(state)
        now = of(first, DISHES).unionAll(of(state, TABLES)).unionAll(of(seated, ROOT))
        if sweep < s.sweeps:
            after = materialize(to_buckets(now, _sweep(root, totals, sweep, root_buckets, s)), "lm-sweep", "kind")
            samples += [of(after, SAMPLE)] if sweep > s.burn_in else []
        else:
            for x in [of(first, ORDER), *samples]:
                now = now.unionAll(x)
            after = materialize(to_buckets(now, _answer(root, totals, root_buckets, s)), "lm-pairs", "kind")
        for x, kind in ((state, TABLES), (state, ASK_ROOT), (state, WIDE), (seated, ROOT)):
            discard(x, f"/kind={kind}")
        state = after
    for x in [first, *samples]:
        discard(x)
    return to_blocks(texts.unionAll(of(state, PAIRS)), _score(word_buckets, buckets, total, kinds, s), RESULT)


def _wide_totals(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids, tables) of the contexts that are dealt by pair, summed over the buckets that hold a part of them."""
    rows = state.filter(f"kind = {WIDE}").select("a", "b").collect()
    if not rows:
        return np.array([], np.uint64), np.array([], np.int64)
    ids = np.frombuffer(b"".join(r["a"] for r in rows), np.uint64)
    key, inverse = np.unique(ids, return_inverse=True)
    return key, np.bincount(inverse, np.frombuffer(b"".join(r["b"] for r in rows), np.int64), minlength=key.size).astype(np.int64)
