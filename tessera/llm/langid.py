"""Language identification by nearest centroids (operator 6).

Texts become counts of hashed letter n-grams (one to three letters, other characters one space).
Document frequencies are counted over all training texts. From at most `sample` training texts a
language, picked by a hash, spherical k-means finds `clusters` centroids of normalised TF-IDF
vectors for each language. A text gets the language of the centroid with the greatest cosine; it is
rejected where that cosine is below what nearly all training texts of the language and length reach.

Nulls and texts without letters: lang `und`, score 0, rejected. Rows without lang are not learned
from. Without any training text all rows are `und`; an empty table gives an empty one, and a model without languages. Repeated rows get the same answer; equal
cosines go to the language first by code point. Very long texts are counted whole, in memory of one
text. Columns of docs pass through identify() but those that it adds. About `sample` texts a language
are picked by hash, never more than twice as many in all, the first by hash, so that reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of n-grams.
WIDTH = 4096
UND = "und"
_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of the text as code points, every run of other characters as one space; spaces at both ends."""
    if not _letters:
        kept = np.arange(0x110000, dtype=np.uint32)
        kept[[not chr(c).isalpha() for c in range(0x110000)]] = 32
        _letters.append(kept)
    c = _letters[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    return c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None without letters."""
    c = _codes(text or "")
    if len(c) < 2:
        return None
    total = np.zeros(WIDTH)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, 4):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = h ^ (h >> np.uint32(15))
        total += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=WIDTH)
    return total


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(raw) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centroids by cosine, from starts that lie far apart."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    c = x[picked]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, 1)
        c = np.array([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Centroids:
    """langs, idf, centroids with the language of each, and for each language the cosine that a text of its length must reach."""

    #: Texts are as long as their number of n-grams says; limits hold from each of these numbers on.
    LENGTHS = np.array([0, 60, 150, 400, 1000, 3000])

    def __init__(self, idf: np.ndarray, sample: dict[str, np.ndarray], clusters: int, slack: float) -> None:
        self.langs = sorted(sample)
        self.idf = idf.astype(np.float32)
        found, of = [], []
        for i, lang in enumerate(self.langs):
            c = _kmeans(vectors(sample[lang].astype(np.float64), idf), clusters)
            found.append(c)
            of += [i] * len(c)
        self.centroids = np.concatenate(found).astype(np.float32) if found else np.zeros((0, WIDTH), np.float32)
        self.of = np.array(of, np.int64)
        self.limits = np.zeros((len(self.langs), len(self.LENGTHS)))
        for i, lang in enumerate(self.langs):
            raw = sample[lang].astype(np.float64)
            near = self._near(vectors(raw, idf))[:, i]
            size = self._size(raw)
            lowest = np.quantile(near, 0.01)
            for b in range(len(self.LENGTHS)):
                mine = near[size == b]
                lowest_here = np.quantile(mine, 0.01) if len(mine) >= 20 else lowest
                self.limits[i, b] = slack * min(lowest, lowest_here)

    def _size(self, raw: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.LENGTHS, raw.sum(1) / 3, side="right") - 1

    def _near(self, v: np.ndarray) -> np.ndarray:
        """The greatest cosine with a centroid of each language."""
        cos = v.astype(np.float32) @ self.centroids.T
        return np.stack([cos[:, self.of == i].max(1) for i in range(len(self.langs))], 1)

    def predict(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cosine, rejected) of each row of counts."""
        near = self._near(vectors(raw.astype(np.float32), self.idf))
        best = np.argmax(near, 1)
        cosine = near[np.arange(len(raw)), best]
        weight = np.exp(25 * (near - cosine[:, None]))
        return best, 1 / weight.sum(1), cosine, cosine < self.limits[best, self._size(raw)]


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Training texts with each n-gram, and their number: sums within each task, then by n-gram."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                raw = counts(text.as_py())
                if raw is not None:
                    df[:-1] += raw > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["i", "n"])

    out = np.zeros(WIDTH + 1, np.int64)
    for r in docs.select("text").mapInArrow(sums, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, clusters: int = 4, sample: int = 600, slack: float = 0.5) -> Centroids:
    """docs: text and lang of the rows to learn from. sample: texts a language that centroids are found from (about)."""
    docs = docs.where("lang is not null and text is not null")
    df, n = _frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    per = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    picked: dict[str, np.ndarray] = {}
    if per:
        share = F.element_at(F.create_map(*(F.lit(x) for kv in per.items() for x in (kv[0], min(1.0, sample / kv[1])))), F.col("lang"))
        salt = [c for c in docs.columns if c not in ("text", "lang")]
        chosen = F.pmod(F.xxhash64("text", *salt), F.lit(1 << 30)) < share * (1 << 30)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, raws = [], []
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = counts(text)
                    if raw is not None:
                        langs.append(lang)
                        raws.append(zlib.compress(raw.astype("<f4").tobytes(), 1))  # nearly all of them are zeros
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(raws, pa.binary())], ["lang", "raw"])

        rows = docs.where(chosen).select("lang", "text").mapInArrow(featured, "lang string, raw binary").orderBy(F.xxhash64("raw"), "lang", "raw").limit(2 * sample * len(per)).collect()
        for lang in per:
            mine = [np.frombuffer(x, "<f4") for x in sorted(zlib.decompress(r["raw"]) for r in rows if r["lang"] == lang)]  # the order must not depend on tasks
            if mine:
                picked[lang] = np.array(mine)
    return Centroids(idf, picked, clusters, slack)


def identify(docs: DataFrame, model: Centroids, block: int = 64) -> DataFrame:
    """docs' columns, with lang_pred, score, cosine and rejected. Columns of these names in docs are replaced. block: texts whose counts are held at a time."""
    own = ("lang_pred", "score", "cosine", "rejected")
    docs = docs.select(*(c for c in docs.columns if c not in own))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, cosine double, rejected boolean"
    text_at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, block):
                batch = whole.slice(lo, block)
                raws = [counts(t.as_py()) for t in batch.column(text_at)]
                lang = np.array([UND] * len(raws), object)
                score, cosine, rejected = np.zeros(len(raws)), np.zeros(len(raws)), np.ones(len(raws), bool)
                there = np.array([r is not None for r in raws], bool)
                if there.any() and model.langs:
                    best, s, c, no = model.predict(np.array([r for r in raws if r is not None]))
                    lang[there] = np.array(model.langs, object)[best]
                    score[there], cosine[there], rejected[there] = s, c, no
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)],
                    [*batch.schema.names, *own],
                )
        pa.default_memory_pool().release_unused()  # the worker may live on beside the next stage

    return docs.mapInArrow(predict, schema)
