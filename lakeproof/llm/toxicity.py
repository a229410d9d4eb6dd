"""Toxicity by weak supervision.

Lexicon words and word-start patterns that go with toxic training labels become voters. A generative label model is fitted to
their votes over all training documents by expectation maximisation: each voter's rates of firing in toxic and other documents,
and the correlations between voters, which discount voters that repeat each other. A linear classifier over all voters is
then trained on the model's posterior labels and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = re.compile(r"[^\W\d_]+")
STARTS = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """labelled: labelled rows that voters are found on, about. sample: documents the classifier is trained on, about, of
    labelled and of others each. voters: most voters. evidence: least log-likelihood ratio of a voter and the label. trust:
    how often a given label is taken to be right. rounds: of expectation maximisation."""

    labelled: int = 20_000
    sample: int = 20_000
    voters: int = 512
    evidence: float = 16.0
    trust: float = 0.999
    rounds: int = 3
    threshold: float = 0.3


@dataclass
class LabelModel:
    """fires: P(vote | label) as (2, voters); weight: share of a voter's evidence that correlated voters don't repeat."""

    prior: float
    fires: np.ndarray
    weight: np.ndarray = field(default=None)

    def terms(self) -> tuple[np.ndarray, float]:
        """Log-odds added by each vote, and the log-odds of no vote at all."""
        on, off = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return self.weight * (on - off), float(np.log(self.prior / (1 - self.prior)) + (self.weight * off).sum())


#: A start is frequent in a text if at least two different words have it, one in so many of the text's words.
FREQUENT = 400


def clues(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and their starts: `x*` for one word, `x*2` for two different, `x*r` for frequent ones."""
    every = WORD.findall((text or "").lower())
    words = set(every)
    starts: dict[str, int] = {}
    for w in words:
        for n in STARTS:
            if len(w) > n:
                starts[w[:n]] = starts.get(w[:n], 0) + 1
    words.update(x + "*" for x in starts)
    for x, n in starts.items():
        if n > 1:
            words.add(x + "*2")
            if n * FREQUENT >= len(every):
                words.add(x + "*r")
    return words


def _ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log-likelihood ratio (G) of clue and label, zero where the clue speaks against the label."""
    n, seen = n_pos + n_neg, pos + neg
    cells = ((pos, seen * n_pos / n), (neg, seen * n_neg / n), (n_pos - pos, (n - seen) * n_pos / n), (n_neg - neg, (n - seen) * n_neg / n))
    g = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0) for o, e in cells)
    return np.where(pos * n_neg > neg * n_pos, g, 0.0)


def find_voters(rows: DataFrame, s: Settings) -> list[str]:
    """The strongest voters from rows (text, toxic), by evidence. A start is left out where a kept longer form fires as often."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                for c in clues(text.as_py()):
                    found.setdefault(c, [0, 0])[toxic] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k][1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int64())], names=["clue", "pos", "neg"])

    counted = rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, "clue string, pos long, neg long")
    # a clue needs at least this many toxic documents to reach the evidence, even if it is in no other
    least = int(np.ceil(s.evidence / (2 * np.log((n_pos + n_neg) / n_pos))))
    summed = counted.groupBy("clue").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter((F.col("pos") >= least) & (F.col("pos") * n_neg > F.col("neg") * n_pos))
    best = summed.orderBy(F.desc(F.col("pos") * F.col("pos") / (F.col("pos") + F.col("neg"))), "clue").limit(8 * s.voters).collect()
    pos, neg = np.array([r["pos"] for r in best], float), np.array([r["neg"] for r in best], float)
    g = _ratio(pos, neg, n_pos, n_neg) if best else np.array([])
    kept: list[str] = []
    seen: dict[tuple, list[str]] = {}
    for k in sorted(range(len(best)), key=lambda k: (-g[k], -len(best[k]["clue"]), best[k]["clue"])):
        clue, same = best[k]["clue"], (best[k]["pos"], best[k]["neg"])
        if g[k] < s.evidence or len(kept) == s.voters:
            break
        stem, _, kind = clue.partition("*")
        if any(x.startswith(stem) for x in seen.get((*same, kind), ())):
            continue
        seen.setdefault((*same, kind), []).append(stem)
        kept.append(clue)
    return kept


def votes(docs: DataFrame, voters: list[str]) -> DataFrame:
    """(doc_id, held_out, fired): the numbers of the voters that fire on each document of docs (doc_id, held_out, text)."""
    by_word = {v: k for k, v in enumerate(voters) if "*" not in v}
    by_start: dict[str, list[tuple[str, int]]] = {}
    for k, v in enumerate(voters):
        stem, star, kind = v.partition("*")
        if star:
            by_start.setdefault(stem, []).append((kind, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], list[str]] | None] = {}
        unknown = object()
        for b in batches:
            fired = []
            for text in b.column(2):
                every = WORD.findall((text.as_py() or "").lower())
                hits: set[int] = set()
                starts: dict[str, int] = {}
                for w in set(every):
                    got = known.get(w, unknown)
                    if got is unknown:
                        mine, stems = [by_word[w]] if w in by_word else [], [w[:n] for n in STARTS if len(w) > n and w[:n] in by_start]
                        got = (mine, stems) if mine or stems else None
                        if len(known) < 500_000:
                            known[w] = got
                    if got:
                        hits.update(got[0])
                        for x in got[1]:
                            starts[x] = starts.get(x, 0) + 1
                for x, n in starts.items():
                    hits.update(k for kind, k in by_start[x] if not kind or n > 1 and (kind == "2" or n * FREQUENT >= len(every)))
                fired.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fired, pa.list_(pa.int32()))], names=["doc_id", "held_out", "fired"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, fired array<int>")


def _flat(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and voter of every vote in list column k of a batch."""
    return np.repeat(np.arange(b.num_rows), np.diff(b.column(k).offsets.to_numpy())), b.column(k).flatten().to_numpy()


def _posterior(model: LabelModel, row: np.ndarray, vote: np.ndarray, label: np.ndarray, trust: float) -> np.ndarray:
    """P(toxic) of rows by their votes and, where label is 0 or 1 and not -1, by a label right as often as trusted."""
    add, none = model.terms()
    odds = none + np.bincount(row, add[vote], minlength=label.size) + np.where(label < 0, 0.0, np.where(label == 1, 1.0, -1.0) * np.log(trust / (1 - trust)))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(patterns: DataFrame, n_voters: int, s: Settings) -> LabelModel:
    """EM over patterns (fired, label, n): votes, a known label or -1, and the count of documents.

    Each round is one pass in which every task sums posteriors and votes under either label; only these sums reach the driver.
    Correlations are taken once, from the labelled documents.
    """
    model = None
    cells = 2 * (n_voters + 1)

    def sums(now: LabelModel | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, n_voters + 1))
            for b in batches:
                row, vote = _flat(b, 0)
                label, n = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
                q = label.astype(float) if now is None else _posterior(now, row, vote, label, s.trust)
                for y, part in ((1, n * q), (0, n * (1 - q))):
                    out[y, :-1] += np.bincount(vote, part[row], minlength=n_voters)
                    out[y, -1] += part.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int64()), pa.array(out.ravel())], names=["cell", "v"])

        return run

    for turn in range(s.rounds + 1):
        rows = patterns.filter("label >= 0") if turn == 0 else patterns
        total = _collect(rows.select("fired", "label", "n").mapInArrow(sums(model), "cell long, v double"), cells).reshape(2, n_voters + 1)
        mass = total[:, -1]
        fires = np.clip((total[:, :-1] + [[0.01], [0.1]]) / (mass[:, None] + 1.0), 1e-6, 1 - 1e-6)
        weight = model.weight if model else _weights(rows, n_voters, fires, mass)
        model = LabelModel(float((mass[1] + 1.0) / (mass.sum() + 2.0)), fires, weight)
    return model


def _collect(parts: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(cells)
    for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        out[r["cell"]] = r["v"]
    return out


def _weights(known: DataFrame, n: int, fires: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """1 / (1 + half the sum of positive correlations with the other voters), the correlations being means over both labels."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n, n))
        for b in batches:
            row, vote = _flat(b, 0)
            label, count = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            bits = np.zeros((b.num_rows, n))
            bits[row, vote] = 1.0
            for y in (0, 1):
                mine = label == y
                sums[y] += (bits[mine] * count[mine, None]).T @ bits[mine]
        at = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at])], names=["cell", "v"])

    both = _collect(known.select("fired", "label", "n").mapInArrow(pairs, "cell long, v double"), 2 * n * n).reshape(2, n, n)
    repeated = np.zeros(n)
    for y in (0, 1):
        p, joint = fires[y], both[y] / (mass[y] + 1.0)
        rho = (joint - np.outer(p, p)) / np.maximum(np.sqrt(np.outer(p * (1 - p), p * (1 - p))), 1e-9)
        np.fill_diagonal(rho, 0.0)
        repeated += np.clip(rho, 0.0, 1.0).sum(axis=1) / 2
    return 1.0 / (1.0 + repeated / 2)


def train(fired: list[list[int]], target: np.ndarray, n_voters: int, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels, by Adam over the whole sample."""
    sizes = np.array([len(x) for x in fired], np.int64)
    row = np.repeat(np.arange(len(fired)), sizes)
    column = np.fromiter((v for x in fired for v in x), np.int64, int(sizes.sum()))
    w = np.zeros(n_voters + 1)
    w[-1] = np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], minlength=len(fired)) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.concatenate((np.bincount(column, gap[row], minlength=n_voters) / len(fired) + decay * w[:-1], [gap.mean()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def held_out(doc_id) -> F.Column:
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(4)) == 2


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_voters) for each row of docs (doc_id, text), by labels (doc_id, toxic).

    Labels of held-out documents are never read; null labels and ids are ignored, and of several labels the highest counts.
    Null and empty texts have no votes and get the score of a document without any. Without labels of both kinds no voter is
    found and every score is the share of toxic labels, 0 without labels. Repeated rows score alike.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id")))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = materialize(usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    n, pos = usable.agg(F.count("*"), F.sum("toxic")).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) / float(1 << 20)
    few = usable.filter(draw < min(1.0, s.labelled / max(n, 1)))  # about s.labelled rows of 12 bytes
    voters = find_voters(base.join(F.broadcast(few), "doc_id").select("text", "toxic"), s)
    if not voters:
        rate = float(pos or 0) / max(n, 1)
        return base.select("doc_id", "held_out", F.lit(rate).alias("score"), F.lit(int(rate >= s.threshold)).alias("predicted"), F.lit(0).alias("n_voters"))
    fired = materialize(votes(base, voters), "toxicity-votes")

    learned = fired.filter("not held_out").select("doc_id", "fired").join(usable.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    learned = materialize(learned.select("doc_id", "fired", F.coalesce("toxic", F.lit(-1)).alias("label")), "toxicity-learned")
    patterns = materialize(learned.groupBy("fired", "label").agg(F.count("*").alias("n")), "toxicity-patterns")
    model = fit_label_model(patterns, len(voters), s)

    sizes = {r["known"]: r["count"] for r in learned.groupBy((F.col("label") >= 0).alias("known")).count().collect()}
    share = F.when(F.col("label") >= 0, min(1.0, s.sample / max(sizes.get(True, 1), 1))).otherwise(min(1.0, s.sample / max(sizes.get(False, 1), 1)))
    sample = learned.filter(draw < share).select("fired", "label").toArrow().combine_chunks()
    lists, label = sample.column("fired").to_pylist(), sample.column("label").to_numpy()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    vote = np.fromiter((v for x in lists for v in x), np.int64, row.size)
    target = _posterior(model, row, vote, label, s.trust)
    weights, intercept = train(lists, target, len(voters))
    line = fired.sparkSession.sparkContext.broadcast(weights)  # at most s.voters numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(2)
            sizes = np.diff(hits.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            z = np.bincount(row, line.value[hits.flatten().to_numpy()], minlength=b.num_rows) + intercept
            p = np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= s.threshold).astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "n_voters"])

    return fired.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, n_voters int")
