"""Quality by a factorisation machine (operator 9).

Inputs: hashed words of the text (each distinct one, scaled by the root of their
number; words of one bucket add up) and structure statistics of the text cut into bins,
its length among them. That is all the metadata there is: labels, language, source and id
are never inputs. The pairwise part
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2`` takes time linear in the
inputs. Fitted with logistic loss by per-coordinate adaptive steps on a bounded sample.

Cases: null ids belong to fold 0 and are scored; rows of equal ids and repeated rows are
scored each; other columns are ignored; null and empty texts get the bins of an empty text and so a score; without
labelled rows of both kinds every score is the share of label 1 (0.5 with none).
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text
from .labelled import fold, labelled_sample

#: Labelled rows that are fitted on, at most.
TRAIN_ROWS = 6000
WORD_BITS, FACTORS, EPOCHS, STEP, DECAY = 13, 6, 6, 0.15, 2e-4
BINS, STATS = 12, 11
INPUTS = (1 << WORD_BITS) + BINS * STATS
_HASH: dict[str, int] = {}


def _bin(share: float) -> int:
    """Bins that grow by powers of two from 1/1024 to 1."""
    return 0 if share <= 0 else max(1, min(BINS - 1, int(math.log2(min(share, 1.0)) + 11)))


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's inputs."""
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    n_bytes = max(1, len(text.encode()))
    words = text.split()
    n, kinds = max(1, len(words)), set(words)
    lines = text.split("\n")
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    letters = int(counts[97:123].sum()) + upper + int(counts[128:].sum())
    signs = n_bytes - letters - digits - int(counts[[32, 10, 9, 13]].sum())
    repeats = sum(map(operator.eq, words, words[1:]))
    stats = [
        upper / max(1, letters),
        digits / n_bytes,
        signs / n_bytes,
        repeats / n,
        len(kinds) / n,
        1 - len(set(lines)) / len(lines),
        int(counts[124]) / n,
        int(counts[33]) / n,
        int(counts[[46, 63]].sum()) / n,
        int(counts[[35, 36, 37, 38, 42]].sum()) / n_bytes,
        len(words) / 1024,
    ]
    if len(_HASH) > 300_000:
        _HASH.clear()
    mask, known = (1 << WORD_BITS) - 1, _HASH
    for word in kinds:
        if word not in known:
            known[word] = zlib.crc32(word.lower().encode()) & mask
    hashed = np.fromiter(map(known.__getitem__, kinds), dtype=np.int32, count=len(kinds))
    binned = np.array([(1 << WORD_BITS) + k * BINS + _bin(x) for k, x in enumerate(stats)], dtype=np.int32)
    at, times = np.unique(hashed, return_counts=True)
    values = np.concatenate([times / math.sqrt(max(1, len(hashed))), np.ones(STATS)])
    return np.concatenate([at, binned]), values.astype(np.float32)


class FactorMachine:
    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(INPUTS, np.float32) if weights is None else weights
        self.factors = np.random.default_rng(7).normal(0, 0.02, (INPUTS, FACTORS)).astype(np.float32) if factors is None else factors

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.weights[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(*inputs(text))))))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> "FactorMachine":
        positive = sum(label for label, _, _ in rows)
        share = min(max(positive / len(rows), 1e-3), 1 - 1e-3) if rows else 0.5
        self.bias = math.log(share / (1 - share))
        if positive in (0, len(rows)):
            self.factors = np.zeros_like(self.factors)
            return self
        gw, gv, gb = np.full(INPUTS, 1e-4, np.float32), np.full((INPUTS, FACTORS), 1e-4, np.float32), 1.0
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                label, at, x = rows[k]
                v = self.factors[at]
                total = (v * x[:, None]).sum(0)
                m = self.bias + self.weights[at] @ x + 0.5 * ((total**2).sum() - ((v * x[:, None]) ** 2).sum())
                slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(m))))) - label
                dw = slope * x + DECAY * self.weights[at]
                dv = slope * x[:, None] * (total[None, :] - v * x[:, None]) + DECAY * v
                gw[at] += dw**2
                gv[at] += dv**2
                gb += slope**2
                self.weights[at] -= STEP * dw / np.sqrt(gw[at])
                self.factors[at] -= 0.3 * STEP * dv / np.sqrt(gv[at])
                self.bias -= STEP * slope / math.sqrt(gb)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorMachine:
    """Executors make the inputs; the driver gets those of at most ``rows`` rows."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", fold(4) != 2, rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [inputs(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "at": pa.array([a.tobytes() for a, _ in made], pa.binary()), "x": pa.array([x.tobytes() for _, x in made], pa.binary())})

    rows = sorted((int(r["label"] > 0), bytes(r["at"]), bytes(r["x"])) for r in sample.mapInArrow(make, "label int, at binary, x binary").collect())
    return FactorMachine().fit([(label, np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)) for label, at, x in rows])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from 0.7)."""
    model = fit_quality(docs, labels)
    bias, weights, factors = model.bias, model.weights, model.factors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorMachine(bias, weights, factors)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(x) for x in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", whole_text().alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
