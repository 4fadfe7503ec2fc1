"""Toxicity by non-negative positive-unlabelled learning (operator 9).

Confirmed toxic texts are the positives; all texts of the training fold are the unlabelled mixture.
Features are whether a text has a word or one of its beginnings (four, five or six bytes), hashed.
Document frequencies of all features are counted over the whole training fold, for positives and for
the mixture; the `features` whose log odds speak most clearly for toxicity are kept. On
bounded samples of both, a numpy logistic model minimises the class-prior-corrected risk
    prior * R(positives as 1) + max(0, R(mixture as 0) - prior * R(positives as 0)),
whose second part is kept from going negative. The prior is the share of toxic labels in the
training fold. Scores are shifted so that 0.3 is where F1 is best, as positives and mixture alone let
it be estimated: recall from the positives, and the share called toxic from the mixture. Confirmed
texts that aren't toxic are used for the prior only.

Nulls: a null text is empty and gets the score of a text without features; a null label teaches
nothing; a doc_id labelled both ways counts as toxic. Without toxic labels every score is nearly 0,
sigmoid(-30). An empty table gives an empty one.
Repeated rows get the same score. Very long texts are read whole, a chunk of rows at a time. Among
features that speak equally the lower number is kept; among equally good cuts the middle one. Columns
of docs pass through score() whatever their names, but score itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_training
from .textnum import LOWER, Hashes, chunks, spans

#: Hash buckets of features.
BITS = 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
#: Beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and beginnings of words; not distinct."""
    low = LOWER[data]
    # capital letters of Latin-1, as two bytes of UTF-8: the second byte's lower case lies 32 above
    capital = np.concatenate(([False], low[:-1] == 0xC3)) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97) if len(low) else np.zeros(0, bool)
    low = np.where(capital, low + 32, low).astype(np.uint8)
    starts, ends, row = spans(_LETTER[low], offsets)
    h = Hashes(low)
    keep = np.uint64(64 - BITS)
    rows, found = [row], [h.of(starts, ends) >> keep]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        rows.append(row[long])
        found.append((h.of(starts[long], starts[long] + n) * np.uint64(2 * n + 1)) >> keep)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | feature)
    return key >> BITS, key & ((1 << BITS) - 1)


def _frequencies(docs: DataFrame) -> np.ndarray:
    """Texts with each feature (last: texts); sums within each task, then by block of features."""
    block = 1 << 10

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + block, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                _, f = _distinct(*features(data, offsets))
                df[: 1 << BITS] += np.bincount(f, minlength=1 << BITS)
                df[1 << BITS] += hi - lo
        parts = df.reshape(-1, block)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[i].tolist() for i in at], pa.list_(pa.int64()))], ["i", "n"])

    total = np.zeros(((1 << BITS) // block + 1, block), np.int64)
    made = docs.select("text").mapInArrow(sums, "i int, n array<long>")
    for i, n in _added(made):
        total[i] = n
    return total.reshape(-1)[: (1 << BITS) + 1]


def _added(parts: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Blocks added up element by element; their number is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = n.values.to_numpy()
                sums[i] = sums[i] + v if i in sums else v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["i", "n"]
        )

    return [(r["i"], np.array(r["n"])) for r in parts.repartition("i").mapInArrow(add, "i int, n array<long>").collect()]


def _sampled(docs: DataFrame, kept: np.ndarray) -> list[np.ndarray]:
    """The kept features of each text, as numbers in `kept`, in an order that doesn't depend on tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(1 << BITS, -1, np.int32)
        index[kept] = np.arange(len(kept))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                row, f = features(data, offsets)
                there = index[f] >= 0
                row, f = _distinct(row[there], index[f[there]])
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([pa.array([f[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["f"])

    return [np.frombuffer(x, "<i4") for x in sorted(bytes(r["f"]) for r in docs.select("text").mapInArrow(rows, "f binary").collect())]


class Scorer:
    """Weights by feature (0 for those not kept) and an offset."""

    def __init__(self, weights: np.ndarray, offset: float, scale: float = 1.0) -> None:
        self.weights, self.offset, self.scale = weights.astype(np.float32), offset, scale

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        there = self.weights[feature] != 0
        row, feature = _distinct(row[there], feature[there])
        return np.bincount(row, self.weights[feature], minlength=n)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.offset, -30, 30)))


def _sums(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.bincount(at, w[np.concatenate(rows)] if len(at) else None, minlength=len(rows))


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the class-prior-corrected risk, by margins of positives and mixture: that of positives as 1, and that of the rest as 0, which may be negative."""
    as_zero = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * float(np.logaddexp(0, -zp).mean()), float(as_zero)


def pu_gradients(flat: list[tuple], zp: np.ndarray, zu: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of both parts of pu_risk by weights and, last, bias. flat: (row, feature) of positives and of the mixture."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    sp, su = sigmoid(zp), sigmoid(zu)

    def back(which: int, g: np.ndarray) -> np.ndarray:
        at, f = flat[which]
        return np.concatenate((np.bincount(f, g[at], minlength=n), [g.sum()]))

    return prior * back(0, (sp - 1) / len(sp)), back(1, su / len(su)) - prior * back(0, sp / len(sp))


def pu_cut(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The margin from which on to call texts toxic: the middle of those with the best F1 that positives and mixture tell of, 2 * prior * recall / (prior + share of the mixture above)."""
    zp, zu = np.sort(zp), np.sort(zu)
    cuts = np.unique(np.concatenate((zp, zu)))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    recall, called = (1 - np.searchsorted(z, cuts) / len(z) for z in (zp, zu))
    f1 = 2 * prior * recall / (prior + called)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(cuts[best[len(best) // 2]])


def nnpu(positive: list[np.ndarray], mixture: list[np.ndarray], n: int, prior: float, rounds: int = 300, rate: float = 0.03, shrink: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of minimal non-negative PU risk, from zero weights; where the second part goes below 0, its gradient is taken back."""
    flat = [(np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate(x) if x else np.zeros(0, int)) for x in (positive, mixture)]
    w = np.concatenate((np.zeros(n), [-2.0]))
    m, v = np.zeros_like(w), np.zeros_like(w)

    for t in range(1, rounds + 1):
        zp, zu = _sums(positive, w[:-1]) + w[-1], _sums(mixture, w[:-1]) + w[-1]
        as_one, as_zero = pu_gradients(flat, zp, zu, n, prior)
        g = as_one + as_zero if pu_risk(zp, zu, prior)[1] >= 0 else -as_zero
        g = g + shrink * np.concatenate((w[:-1], [0.0]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def crossed(positive: list[np.ndarray], mixture: list[np.ndarray], n: int, prior: float, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Margins of positives and mixture by models that haven't seen them, as a model thinks too well of what it has learned from; the positives' own, where they are fewer than the folds."""
    if len(positive) < folds or len(mixture) < folds:
        w, bias = nnpu(positive, mixture, n, prior)
        return _sums(positive, w) + bias, _sums(mixture, w) + bias
    zp, zu = [], []
    for k in range(folds):
        w, bias = nnpu([x for i, x in enumerate(positive) if i % folds != k], [x for i, x in enumerate(mixture) if i % folds != k], n, prior)
        zp.append(_sums(positive[k::folds], w) + bias)
        zu.append(_sums(mixture[k::folds], w) + bias)
    return np.concatenate(zp), np.concatenate(zu)


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = 10_000, n_features: int = 20_000, purity: float = 0.9) -> Scorer:
    """docs: doc_id and text of the training fold. labels: doc_id and toxic; only rows of the training fold are used.

    sample: at most so many toxic texts, and about as many of the mixture, fit the weights and the cut.
    """
    spark = docs.sparkSession
    known = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    nothing = Scorer(np.zeros(1 << BITS), -30.0)
    if not share["n"] or not share["p"]:
        return nothing
    toxic = known.where("toxic > 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = spark.createDataFrame([(r["doc_id"],) for r in toxic.collect()], known.select("doc_id").schema)
    labelled = docs.join(F.broadcast(ids), "doc_id")  # at most `sample` ids
    freq_p, freq_u = _frequencies(labelled), _frequencies(docs)
    if not freq_p[-1]:
        return nothing
    p, u = freq_p[:-1], freq_u[:-1]
    odds = np.log((p + 0.5) / (freq_p[-1] + 1)) - np.log((u + 0.5) / (freq_u[-1] + 1))
    # of the mixture's texts with the feature, so many must be toxic by the prior; odds end at -log(prior)
    pure = float(share["p"]) * np.exp(odds) >= purity
    clear = np.where((p >= max(2, 0.003 * freq_p[-1])) & pure, odds * np.sqrt(p), 0)
    kept = np.sort(np.argsort(-clear, kind="stable")[: min(n_features, int((clear > 0).sum()))])
    total = int(freq_u[-1])
    mixture = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < min(1.0, sample / total) * (1 << 30))
    pos, mixed = (_sampled(d, kept) for d in (labelled, mixture))
    if not mixed:
        return nothing
    prior = float(share["p"])
    w, bias = nnpu(pos, mixed, len(kept), prior)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    at = pu_cut(*crossed(pos, mixed, len(kept), prior), prior)
    return Scorer(weights, bias - at + float(np.log(cut / (1 - cut))))


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """docs' columns but text, with score. A column of that name in docs is replaced."""
    docs = docs.select(*(c for c in docs.columns if c != "score"))
    kept = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    at = docs.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(at)):
                out[lo:hi] = model.score(model.margin(*features(data, offsets), hi - lo))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out)], [*(f.name for f in kept), "score"])

    return docs.mapInArrow(rate, schema)
