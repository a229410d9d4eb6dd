"""SimHash near-duplicates found by deletion-variant signatures.

Up to `distance` = 4 differing bits over three segments leave one segment with at most one differing bit. Every distinct
fingerprint is therefore indexed under its 64 one-wildcard segment variants; two linked fingerprints share at least one.
Equal variants meet by a shuffle, are verified by their Hamming distance, and give the links of a spanning forest only, so a
dense group costs rows in proportion to its members. Copies collapse to one fingerprint before any of this. A fingerprint is
shuffled 9 times, not 64: a segment is cut into three parts, and the variants with their wildcard in one part travel as one
row to the task named by the other two, where they are spelled out.

Near copies of a given Jaccard similarity take a wide fingerprint of several 64-bit words: at similarity 0.8 about 15 % of the
bits differ, too many for any four bits. Each word is cut and indexed as above, one pass for each, and a pair is verified over
the bits of all words, whose share of differing bits estimates the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize
from .components import Forest, components

WIDTH, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, bits) of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A run of equal variants up to this length is compared by shifts, a longer one by search.
SHORT_RUN = 16
#: A run longer than this is split: by second-level variants over the other two segments, of wide fingerprints into blocks.
LONG_RUN = 200_000
#: Rows of two blocks of a long run of wide fingerprints, which one task compares.
TWO_BLOCKS = 50_000
#: Rows of a long run of wide fingerprints that all its rows are compared with where the run is found.
HEADS = 64


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles of a UTF-8 text, repeats included; of fewer words, of the whole sequence; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.array([], np.uint64)
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([xxh(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:-width])).tolist()
    ends = (stops[width - 1 :] - 1).tolist()
    return np.fromiter((xxh(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have; zero of none."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """SimHash of the word shingles of a UTF-8 text; zero for null and wordless texts."""
    return int(majority(shingles(text, width)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_fingerprints, "doc_id long, fp long")


def _wildcards(bits: Column, cuts: tuple[tuple[int, int], ...]) -> Column:
    """One long for each wildcard position of each (lowest bit, width) segment: the position above 32 bits of the other bits."""
    out = []
    for low, width in cuts:
        part = F.shiftrightunsigned(bits, low)
        out += [F.lit((low + j) << 32).cast("long").bitwiseOR(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))) for j in range(width)]
    return F.array(*out)


def variants(fp: Column) -> Column:
    return _wildcards(fp, SEGMENTS)


def _parts() -> list[tuple[int, int, int, int]]:
    """(segment's lowest bit, its bits, part's lowest bit within it, part's bits) of the three parts of each segment."""
    out = []
    for low, width in SEGMENTS:
        third = width // 3
        out += [(low, width, 0, third), (low, width, third, third), (low, width, 2 * third, width - 2 * third)]
    return out


def routes(fp: Column) -> Column:
    """One long for each part of a segment: the part's number above 32 bits of the segment without the part's bits. Equal
    variants have equal routes."""
    out = []
    for number, (low, width, at, bits) in enumerate(_parts()):
        rest = ((1 << width) - 1) & ~(((1 << bits) - 1) << at)
        out.append(F.lit(number << 32).cast("long").bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(rest))))
    return F.array(*out)


def routed_variants(fp: Column, route: Column) -> Column:
    """The variants of a fingerprint whose wildcard is in the part that a route of it names."""
    number, out = F.shiftrightunsigned(route, 32), None
    for k, (low, width, at, bits) in enumerate(_parts()):
        mine = F.array(*[F.lit((low + j) << 32).cast("long").bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))) for j in range(at, at + bits)])
        out = F.when(number == k, mine) if out is None else out.when(number == k, mine)
    return out


def sub_variants(fp: Column, key: Column) -> Column:
    """Second-level variants for a long run: the two segments other than that of `key`, cut into three again."""
    position, out = F.shiftrightunsigned(key, 32), None
    for low, width in SEGMENTS:
        top, n = low + width, 64 - width
        rest = fp if top == 64 else F.shiftrightunsigned(fp, top).bitwiseOR(F.shiftleft(fp, 64 - top))
        third = n // 3
        subs = _wildcards(rest, ((0, third), (third, third), (2 * third, n - 2 * third)))
        mine = (position >= low) & (position < top)
        out = F.when(mine, subs) if out is None else out.when(mine, subs)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, given as words or as rows of words."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def node(fps: np.ndarray) -> np.ndarray:
    """A fingerprint's number in the graph of links: of one word the word itself, of several a hash of them."""
    if fps.shape[1] == 1:
        return fps[:, 0]
    out = np.zeros(len(fps), np.uint64)
    for k in range(fps.shape[1]):
        out = (out ^ fps[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def search_at(x: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places of linked pairs that connect every two of the fingerprints x (words, or rows of words) within `distance`; each
    place but the first of a component is reached once."""
    left, at, sources, members = x, np.arange(len(x)), [], []
    while len(left) > 1:
        queue = [(at[0], left[0])]
        left, at = left[1:], at[1:]
        while queue and len(left):
            source, print_ = queue.pop()
            near = differing(left, print_) <= distance
            if near.any():
                sources.append(np.full(int(near.sum()), source))
                members.append(at[near])
                queue.extend(zip(at[near], left[near]))
                left, at = left[~near], at[~near]
    return sources, members


def search(x: np.ndarray, distance: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The linked fingerprints at the places of search_at."""
    sources, members = search_at(x, distance)
    return [x[k] for k in sources], [x[k] for k in members]


def _links(keys: np.ndarray, fps: np.ndarray, names: np.ndarray, forest: Forest, distance: int) -> None:
    """Adds the verified links of whole runs of equal keys to the forest, by names; a link within one name tells nothing."""

    def add(a: np.ndarray, b: np.ndarray) -> None:
        a, b = names[a], names[b]
        forest.add(a[a != b], b[a != b])

    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.array([], int)
    sizes = np.diff(np.concatenate((starts, [keys.size])))
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        for a, b in zip(*search_at(fps[s : s + n], distance)):
            add(s + a, s + b)
    run = np.repeat(sizes, sizes)
    short = np.flatnonzero((run > 1) & (run <= SHORT_RUN))
    keys, fps = keys[short], fps[short]
    for d in range(1, SHORT_RUN):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not same.size:
            break
        near = same[differing(fps[same], fps[same + d]) <= distance]
        add(short[near], short[near + d])


def _linker(limit: int, words: int = 1, distance: int = DISTANCE):
    """Streams (key, name, words of the fingerprint) rows sorted by key, of one word without a name, which is the word itself;
    yields (a, b, long_key): links between names, or the key of a run over the limit. Of several words, the rows of such a run
    are linked to HEADS of its rows only, which leaves less to its blocks."""
    first = 1 if words == 1 else 2

    def to_heads(forest: Forest, heads: tuple[np.ndarray, np.ndarray], names: np.ndarray, fps: np.ndarray) -> None:
        for name, head in zip(*heads):
            near = differing(fps, head) <= distance
            other = names[near & (names != name)]
            forest.add(np.full(other.size, name), other)
            names, fps = names[~near], fps[~near]

    def out(forest: Forest, over: list[int]) -> pa.RecordBatch:
        a, b = forest.links()
        rows = [a + [None] * len(over), b + [None] * len(over), [None] * len(a) + over]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["a", "b", "long_key"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, over, skip, heads = Forest(), [], None, None
        keys, names, fps = np.array([], np.int64), np.array([], np.uint64), np.zeros((0, words), np.uint64)
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            f = np.stack([batch.column(first + j).to_numpy().view(np.uint64) for j in range(words)], axis=1)
            if skip is not None:
                rest = k != skip
                if heads:
                    to_heads(forest, heads, n[~rest], f[~rest])
                k, n, f = k[rest], n[rest], f[rest]
            keys, names, fps = np.concatenate((keys, k)), np.concatenate((names, n)), np.concatenate((fps, f))
            if not keys.size:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            _links(keys[:whole], fps[:whole], names[:whole], forest, distance)
            keys, fps, names = keys[whole:], fps[whole:], names[whole:]
            if limit and keys.size > limit:
                skip = int(keys[0])
                over.append(skip)
                if words > 1:
                    some = np.linspace(0, keys.size - 1, min(HEADS, keys.size)).astype(int)
                    heads = names[some], fps[some]
                    to_heads(forest, heads, names, fps)
                keys, fps, names = keys[:0], fps[:0], names[:0]
            if forest.pending > 1 << 20:
                yield out(forest, [])
                forest = Forest()
        _links(keys, fps, names, forest, distance)
        yield out(forest, over)

    return link


def links(distinct: DataFrame, limit: int = LONG_RUN) -> DataFrame:
    """(a, b): links that connect all fingerprints of the column fp that differ in at most DISTANCE bits, directly or in turn."""
    return _indexed_links(distinct, ["fp"], 1, F.col("fp"), DISTANCE, limit, lambda key: sub_variants(F.col("fp"), key))


def _indexed_links(distinct: DataFrame, carried: list[str], words: int, word: Column, distance: int, limit: int, again: Callable[[Column], Column] | None = None) -> DataFrame:
    """Links of fingerprints that share a variant of `word`. Runs over the limit are split by the keys of `again`, if keys can
    be given that lose no link; without them by blocks of which every two meet. The columns carried are a name and the words,
    or the one word."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = distinct.select(F.explode(routes(word)).alias("route"), *carried).repartition(parts, "route")
    schema = "a long, b long, long_key long"

    def link(rows: DataFrame, most: int) -> DataFrame:
        """Rows with equal keys lie in one partition."""
        return materialize(rows.sortWithinPartitions("key").mapInArrow(_linker(most, words, distance), schema), "simhash-links")

    found = link(routed.select(F.explode(routed_variants(word, F.col("route"))).alias("key"), *carried), limit)
    out, over = found.filter("long_key is null").select("a", "b"), found.filter("long_key is not null")
    if over.isEmpty():
        return out
    over = over.select(F.col("long_key").alias("key"))

    def searched(rows: DataFrame, *group: str) -> DataFrame:
        """Links within each group of rows."""
        return link(rows.select(F.xxhash64(*group).alias("key"), *carried).repartition(parts, "key"), 0).select("a", "b")

    if again:
        indexed = distinct.select(F.explode(variants(word)).alias("key"), *carried)
        return out.unionAll(searched(indexed.join(over, "key").select(F.explode(again(F.col("key"))).alias("sub"), "key", *carried), "key", "sub"))
    name, digest = carried[0], F.xxhash64(*carried[1:])
    roots = components(out).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rooted = distinct.join(roots, F.col(name) == F.col("_node"), "left").select(F.coalesce("_root", name).alias("_root"), *carried)
    rooted = materialize(rooted, "simhash-long")
    rows = rooted.select(F.explode(variants(word)).alias("key"), "_root", *carried).join(over, "key")
    rows = _two_blocks(rows, digest, max(1, min(limit, TWO_BLOCKS) // 2))
    return out if rows is None else out.unionAll(searched(rows, "key", "_low", "_high"))


def _two_blocks(rows: DataFrame, digest: Column, block: int) -> DataFrame | None:
    """Rows (key, _root, any others) of long runs with _low and _high, the numbers of two blocks of the run, or None if none need meet.

    What has one root is connected and needs no more links. Of each run, the rows of the commonest root and all others are dealt
    to blocks by their digest; each block of others meets every other block, so every two rows of different roots meet.
    """
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("long")
    counts = rows.groupBy("key", "_root").agg(F.count("*").alias("_n"))
    split = counts.groupBy("key").agg(F.max(F.struct("_n", "_root")).alias("_top"), F.sum("_n").alias("_all")).filter("_all > _top._n")
    split = split.select("key", F.col("_top._root").alias("_commonest"), blocks(F.col("_top._n")).alias("_most"), blocks(F.col("_all") - F.col("_top._n")).alias("_others"))
    split = materialize(split, "simhash-split")
    if split.isEmpty():
        return None
    # the blocks of others have the first numbers
    most = F.col("_root") == F.col("_commonest")
    at = F.when(most, F.col("_others") + F.pmod(digest, "_most")).otherwise(F.pmod(digest, "_others"))
    end = F.when(most, F.col("_others")).otherwise(F.col("_others") + F.col("_most"))
    dealt = rows.join(split, "key").withColumn("_at", at).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), end - 1)))
    return dealt.filter("_at <> _with").withColumns({"_low": F.least("_at", "_with"), "_high": F.greatest("_at", "_with")})


#: Tasks that the rows of one root are dealt to when they learn their component's name.
ROOT_SALTS = 8


def near_duplicates(docs: DataFrame, limit: int = LONG_RUN) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text, any others).

    component_id is the smallest doc_id reachable over links. Null, empty and wordless texts share fingerprint zero; a null
    doc_id never becomes a component_id unless its whole component has none; repeated rows stay repeated.
    """
    prints = materialize(fingerprints(docs), "simhash-prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    roots = materialize(components(links(firsts.select("fp"), limit)), "simhash-roots")
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted.withColumn("salt", F.pmod("fp", F.lit(ROOT_SALTS))), "simhash-rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    lowest = materialize(lowest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROOT_SALTS - 1).cast("long")))), "simhash-lowest")
    named = materialize(rooted.join(lowest, ["root", "salt"]).select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Near:
    """Shingle width, words of 64 bits in a fingerprint, and the least similarity of near copies."""

    width: int = 5
    words: int = 6
    similarity: float = 0.8

    @property
    def distance(self) -> int:
        """Differing bits expected at the similarity (the angle between two shingle vectors of equal length over pi) and one
        standard deviation more, so that most pairs just as similar as asked are within it."""
        n, share = 64 * self.words, math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return int(n * share + math.sqrt(n * share * (1 - share)))


def wide_fingerprint(text: bytes | None, near: Near = Near()) -> np.ndarray:
    """The words of a wide fingerprint: word k takes the majority of the shingles' hashes, mixed with k."""
    hashes = shingles(text, near.width)
    if not hashes.size:
        return np.zeros(near.words, np.uint64)
    out = [majority(hashes)]
    for k in range(1, near.words):
        x = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(majority(x ^ (x >> np.uint64(32))))
    return np.array(out)


def similar_links(distinct: DataFrame, near: Near = Near(), limit: int = LONG_RUN) -> DataFrame:
    """(a, b): links that connect the nodes whose fingerprints (columns f0, f1, ...) are near enough, by one pass for each word.

    A pass finds a pair that differs in at most one bit of one of the word's three segments; a pair just as similar as asked is
    found by some pass with a chance of 1 - 0.85 ** (3 * words), 95 % with 6 words. Runs over the limit find the same pairs.
    """
    words = [f"f{k}" for k in range(near.words)]

    def by_word(named: DataFrame, k: int) -> DataFrame:
        return _indexed_links(named, ["node", *words], near.words, F.col(words[k]), near.distance, limit)

    # what the first word connects bears one name from then on, so later passes tell of new links only
    roots = materialize(components(by_word(distinct, 0)).select(F.col("node").alias("a"), F.col("root").alias("b")), "simhash-first")
    named = distinct.join(roots, F.col("node") == F.col("a"), "left").select(F.coalesce("b", "node").alias("node"), *words)
    named, out = materialize(named, "simhash-named"), roots
    for k in range(1, near.words):
        out = out.unionAll(by_word(named, k))
    return out


def keep_one(docs: DataFrame, near: Near = Near(), limit: int = LONG_RUN) -> DataFrame:
    """Docs (doc_id, text, any others) without near copies: of each group the row of the smallest doc_id, null ids last.

    Rows are told apart by doc_id and text, so texts that share an id, or have none, are judged by themselves; of rows equal in
    both, one stays. Null, empty and wordless texts are copies of each other. An empty table stays empty.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    words = [f"f{k}" for k in range(near.words)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([wide_fingerprint(x.as_py(), near) for x in b.column(2)], np.uint64).reshape(-1, near.words)
            columns = [pa.array(x.view(np.int64)) for x in (node(fps), *np.ascontiguousarray(fps.T))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "key", "node", *words])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, key long, node long, " + ", ".join(f"{w} long" for w in words)
    found = materialize(source.mapInArrow(prints, schema), "simhash-prints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("key"))
    firsts = materialize(found.groupBy("node").agg(F.min(place).alias("first"), *[F.first(w).alias(w) for w in words]), "simhash-firsts")
    roots = materialize(components(similar_links(firsts, near, limit)).withColumnRenamed("node", "_node"), "simhash-roots")
    rooted = firsts.join(roots, F.col("node") == F.col("_node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_kept_key"))
    repeats = found.groupBy(F.col("key").alias("_kept_key")).agg(F.count("*").alias("_n_rows"))
    # the keys grow with the corpus: they are merged at every size, never broadcast
    chosen = materialize(chosen.join(repeats.hint("merge"), "_kept_key"), "simhash-kept")
    keyed = docs.select(F.struct(*columns(docs)).alias("_doc"), key.alias("_key"))
    kept = keyed.join(chosen.hint("merge"), F.col("_key") == F.col("_kept_key"))
    once = kept.filter("_n_rows = 1").select("_doc")
    if not chosen.filter("_n_rows > 1").isEmpty():
        once = once.unionByName(kept.filter("_n_rows > 1").dropDuplicates(["_kept_key"]).select("_doc"))
    return once.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
