"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes hashed counts of its words, of word shapes (case, digits and the punctuation around a word, runs joined)
and coarse figures of length and repetition. The bounded labelled sample gives inverse document frequencies and, through the
singular vectors of its weighted matrix, a projection to a few dozen latent dimensions. The sample's vectors are
broadcast (sample x dimensions floats: 1 MB by default); every document's exact cosine to all of them is computed in
blocks, and the labels of its nearest neighbours vote, weighted by similarity.

Defined results: null and empty texts count as empty and get a score like any text; a vector of zeros gets the
sample's share of label 1; without labelled rows every score is 0.5; rows with a null label are not learned from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.llm.common import small_batches

#: Bound of the labelled sample: rows of least hash. The classifier's only sample; scoring covers all rows.
SAMPLE, DIMS, LATENT, NEIGHBOURS = 2000, 4096, 48, 15
_FIGURES, _SHAPES = 64, 1024  # ends of the first columns: figures of a text, word shapes; the words themselves take the rest
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_UPPER = bytes(range(65, 91))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _feature(word: bytes) -> int:
    """Columns of a word's shape and of the word itself, letters' case and marks around it aside, as one number."""
    shape = _RUN.sub(rb"\1\1", word.translate(_SHAPE))
    size = min(len(word), 40) // 4
    bare = word.lower().strip(_SIGNS) or word
    return (_FIGURES + zlib.crc32(b"%d %b" % (size, shape)) % (_SHAPES - _FIGURES)) * DIMS + _SHAPES + zlib.crc32(bare) % (DIMS - _SHAPES)


class Features(dict):
    """Words to numbers of their columns, worked out at first sight."""

    def __missing__(self, word: bytes) -> int:
        out = _feature(word)
        if len(word) <= 64:
            self[word] = out
        return out


def features(text: str | None, cache: Features) -> np.ndarray:
    """Counts damped by a logarithm; figures take one of a few columns each, with a weight of their own."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(DIMS, np.float32)
    n = len(words)
    if n:
        cols = np.fromiter(map(cache.__getitem__, words), np.int64, n)
        out += np.bincount(cols // DIMS, minlength=DIMS)
        out += np.bincount(cols % DIMS, minlength=DIMS)
        out *= 100.0 / n
        np.log1p(out, out)
    again = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    lines = raw.split(b"\n")
    upper, sign = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _SIGNS))
    shares = (len(set(words)) / n if n else 0.0, again, len(set(lines)) / len(lines), upper / (len(raw) or 1), sign / (len(raw) or 1))
    for k, share in enumerate(shares):
        out[8 * k + min(7, int(8 * share**0.5))] = 3.0
    out[40 + min(15, len(raw).bit_length() - 1 if raw else 0)] = 1.0
    return out


class Voter:
    """The fitted model: weights, projection, unit vectors and labels of the sample; all of bounded size."""

    def __init__(self, x: np.ndarray, y: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        self.k, self.y = neighbours, y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = self._weigh(x)
        # right singular vectors by way of the sample's inner products, whose size is bounded by the sample
        values, vectors = np.linalg.eigh((weighted @ weighted.T).astype(np.float64))
        top = np.flatnonzero(values > 1e-6)[::-1][:latent]
        self.project = weighted.T @ (vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
        self.known = self._unit(weighted @ self.project)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit((x * self.idf).astype(np.float32, copy=False))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        """Rows scaled to length one, in place."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        x /= np.where(norm > 0, norm, 1)
        return x

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(self.k, len(self.y))
        for at in range(0, len(x) if k else 0, block):
            v = self._unit(self._weigh(x[at : at + block]) @ self.project)
            cosine = v @ self.known.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8
            total = weight.sum(axis=1)
            vote = (weight * self.y[near]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + block] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Voter:
    """Fit on at most ``sample`` labelled rows of ``labels`` (those of least hash, so the same at every size)."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id", F.lit(7)), "id", "y")
        .limit(sample)
    )
    small_batches(docs.sparkSession)
    # documents that repeat an id with another text are one labelled row too, so the sample stays bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")

    def run(batches):
        cache = Features()
        for batch in batches:
            at, value = [], []  # of each row's columns only those that are not 0 travel to the driver
            for t in batch.column(1):
                x = features(t.as_py(), cache)
                at.append(np.flatnonzero(x).astype(np.int32).tobytes())
                value.append(x[x != 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["id", "y", "at", "value"])

    rows = texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, y int, at binary, value binary").orderBy("id", "y").collect()
    x = np.zeros((len(rows), DIMS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
    return Voter(x, np.array([r.y for r in rows], np.float32))


def scorer(spark: SparkSession, voter: Voter) -> Callable[[Column], Column]:
    """A column function from texts to scores; only texts travel to Python."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(voter)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = Features()
        for texts in batches:
            out = []
            for at in range(0, len(texts), 500):
                if len(cache) > 200_000:
                    cache.clear()
                x = np.stack([features(t.as_py(), cache) for t in texts.slice(at, 500)])
                out.append(model.value.score(x))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return lambda text: scores(text.cast("string"))


def score(docs: DataFrame, voter: Voter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score double for every row."""
    return docs.select(F.col(id_col), scorer(docs.sparkSession, voter)(F.col(text_col)).alias("score"))
