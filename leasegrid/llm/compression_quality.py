"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of a fixed number of bytes; each is compressed once with the dictionary
of good and once with that of bad labelled text. The normalised size difference
(bad - good) / (bad + good), its spread over the blocks, and the sizes against the raw text are
turned into a calibrated score by a logistic fit on labelled rows that built no dictionary.

The fit uses a bounded sample: about ``per_class`` rows of each label, drawn by a hash of the id
from texts of at most ``max_chars`` characters. Scoring covers every row and whole texts.

Null and empty texts have no blocks: they get the label share of the sample's empty texts,
smoothed by the share of all. Without labels of both kinds every text gets the share of label 1 in
the sample (0.5 without any). Repeated label rows count once; a document with both labels counts
under both. Rows are independent: repeated and null ids pass through, other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean

#: bytes per compressed block
CHUNK = 2048
LEVEL = 3


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples to train, their raw bytes."""
    samples = [t[k:k + CHUNK] for t in texts for k in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(d) for d in (good, bad))

    @staticmethod
    def _compressor(data: bytes):
        if len(data) < 8:
            return zstandard.ZstdCompressor(level=LEVEL)
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=False)

    def features(self, text: bytes) -> list[float] | None:
        """Mean, least and largest block difference, and compressed against raw size: mean and least."""
        if not text:
            return None
        raw, good, bad = [], [], []
        for k in range(0, len(text), CHUNK):
            part = text[k:k + CHUNK]
            raw.append(len(part))
            good.append(len(self.good.compress(part)))
            bad.append(len(self.bad.compress(part)))
        raw, good, bad = np.array(raw, float), np.array(good, float), np.array(bad, float)
        # a short last block says little alone
        w = raw / raw.sum()
        each = (bad - good) / (bad + good) * np.minimum(1, raw / CHUNK * 4)
        ratio = np.minimum(2, (bad + good) / (2 * raw + 32))
        return [float((bad.sum() - good.sum()) / (bad.sum() + good.sum())), float(each.min()), float(each.max()),
                float((w * ratio).sum()), float(ratio.min()), float(np.log1p(raw.sum()))]


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares and products with the mean difference."""
    return np.concatenate((x, x**2, x[:, :1] * x[:, 1:]), axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (constant last) by damped Newton steps."""
    a = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray | None
    std: np.ndarray | None
    weights: np.ndarray | None
    empty: float
    share: float

    def scorer(self):
        sizes = Sizes(self.good, self.bad) if self.weights is not None else None

        def score(texts: list[bytes]) -> np.ndarray:
            out = np.full(len(texts), self.share)
            found = [(k, f) for k, t in enumerate(texts) if t and sizes is not None for f in [sizes.features(t)]]
            if found:
                x = (expand(np.array([f for _, f in found])) - self.mean) / self.std
                z = np.concatenate((x, np.ones((len(x), 1))), axis=1) @ self.weights
                out[[k for k, _ in found]] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out[[k for k, t in enumerate(texts) if not t]] = self.empty
            return out

        return score


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 20_000, dict_size: int = 112 << 10,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from a sample of at most about ``per_class`` rows of each label."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").distinct()
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(b"", b"", None, None, None, 0.5, 0.5)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, counts.get(0, 0)))))
    sample = marked.where(draw < rate * (1 << 30))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
            .join(F.broadcast(sample), "id")
            .select("y", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).alias("build"))
            .toPandas().sort_values(["y", "text"]))
    y = rows["y"].to_numpy(float)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total
    texts = [t.encode() for t in rows["text"]]
    none = np.array([not t for t in texts], bool)
    empty = float((y[none].sum() + share) / (none.sum() + 1)) if len(y) else share
    build = rows["build"].to_numpy(bool)
    good = [t for t, k, b in zip(texts, y, build, strict=True) if t and b and k == 1]
    bad = [t for t, k, b in zip(texts, y, build, strict=True) if t and b and k == 0]
    fit = ~build & ~none
    if not good or not bad or len(set(y[fit])) < 2:
        return Model(b"", b"", None, None, None, empty, share)
    g, b = dictionary(good, dict_size), dictionary(bad, dict_size)
    sizes = Sizes(g, b)
    x = expand(np.array([sizes.features(t) for t, use in zip(texts, fit, strict=True) if use]))
    y = y[fit]
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = fit_logistic((x - mean) / std, y)
    # the sample is balanced by label; the constant is moved back to the labels' own shares
    drawn = y.mean()
    w[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)) if 0 < share < 1 else 0
    return Model(g, b, mean, std, w, empty, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; 1 is good."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = model.scorer()
        for b in batches:
            text = b.column(1).fill_null("").cast(pa.large_binary())
            out = [scorer([t.as_py() for t in text.slice(k, 256)]) for k in range(0, len(text), 256)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double")
