"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every text are computed once and kept as a small table. Random Fourier features of the scaled statistics
stand for a Gaussian kernel; each task adds up its rows' normal equations, tasks' sums are added up in turn, and one
small system is solved. Rows are scored by the fold that did not see them, those scores are counted in bins, and a rising
step function through the bins calibrates the scores.

Defined results: a null or empty text has statistics and a score like any other; without labels every score is 0.5;
labels without a quality are left out; a repeated label counts again, and a repeated row is scored again with the same
score; equal scores keep no order, 0.5 counts as label 1; very long texts are read whole, in slices; an empty table gives an empty table; other
columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textbytes import folded, slices, span_hashes

STATISTICS = ["bytes", "words", "word_length", "word_spread", "short_words", "distinct_words", "upper", "digits", "stops", "symbols", "symbol_ends", "line_breaks", "wide", "stop_words"]
#: Bins over raw scores from -0.5 to 1.5.
BINS = 400


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a text, a column a statistic."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, size)

    white = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~white
    cut = np.zeros(len(data) + 2, bool)  # words end at the ends of texts
    cut[offsets + 1] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1
    own = np.searchsorted(offsets, start, "right") - 1
    length = (end - start).astype(float)
    words = np.bincount(own, minlength=n).astype(float)
    per = lambda v: np.bincount(own, v, minlength=n) / np.maximum(1, words)
    mean = per(length)
    seen = _distinct(own, span_hashes(folded(data), start, end))
    letter = (((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 0x80)
    plain = letter | white | ((data >= 48) & (data <= 57)) | (data == 46) | (data == 44)
    odd_end = ~plain[end - 1] if len(end) else np.zeros(0, bool)
    out = [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, per(length**2) - mean**2)), per(length <= 3), np.bincount(seen, minlength=n) / np.maximum(1, words), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share((data == 46) | (data == 44)), share(~plain), per(odd_end), share(data == 10), share(data >= 0x80), per((length <= 4) & ~odd_end)]
    return np.stack(out, 1)


def _distinct(own: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The owner of each distinct (owner, key)."""
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    return own[first]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, data, offsets in slices(b.column("text")):
            s = text_statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(s)), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))], ["id", "s"])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    level: np.ndarray

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.scale, -4, 4)
        phi = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([phi, z, np.ones((len(s), 1))])

    def score(self, s: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(s), 0.5)
        raw = self.features(s) @ self.beta
        rank = 1 / (1 + np.exp(-8 * (raw - 0.5)))  # keeps the order of scores on one step
        return np.clip(0.98 * np.interp(raw, self.knots, self.level) + 0.02 * rank, 0, 1)


def _batch(b: pa.RecordBatch) -> np.ndarray:
    return b.column("s").flatten().to_numpy().reshape(len(b), -1)


def _sums(model: QualityModel, slots: int):
    """Each task's sums of the normal equations, one matrix a fold, with the slot where tasks' sums meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            x = model.features(_batch(b))
            x = np.hstack([x, y[:, None]])
            for f in (0, 1):
                own = x[fold == f]
                total[f] = total.get(f, 0) + own.T @ own
        rows = [{"slot": TaskContext.get().partitionId() % slots, "fold": f, "sums": t.astype("<f8").tobytes()} for f, t in total.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)

    return run


_SUMS = pa.schema([("slot", pa.int32()), ("fold", pa.int32()), ("sums", pa.binary())])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for r in b.to_pylist():
            k = (r["slot"], r["fold"])
            total[k] = total.get(k, 0) + np.frombuffer(r["sums"], "<f8")
    yield pa.RecordBatch.from_pylist([{"slot": s, "fold": f, "sums": t.tobytes()} for (s, f), t in total.items()], schema=_SUMS)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to `mean` by weight: neighbours that fall are pooled. x is in order already."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), m) for m, _, k in blocks]) if blocks else np.zeros(0)


def _raw(model: QualityModel, betas: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            x = model.features(_batch(b))
            raw = np.where(fold == 0, x @ betas[1], x @ betas[0])
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("y")], ["raw", "y"])

    return run


def fit_quality(stats: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", label_col: str = "quality", features: int = 192, width: float = 1.0, ridge: float = 1.0, seed: int = 7, slots: int = 16) -> QualityModel:
    """stats(id, s); labels with id_col and label_col, of which the rows where train holds are learnt from."""
    k = len(STATISTICS)
    row = stats.agg(*[f(F.col("s")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    mean, dev = (np.array([row[f"{n}{i}"] or 0.0 for i in range(k)]) for n in "md")
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(dev > 1e-12, dev, 1.0), rng.normal(size=(k, features)) / (width * np.sqrt(k)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + k + 1), np.zeros(0), np.zeros(0))
    learn = labels.where(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = keep(stats.join(learn, "id").select("s", "y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold")), "labelled")
    spec = "slot int, fold int, sums binary"
    got = rows.mapInArrow(_sums(model, slots), spec).repartition("slot").mapInArrow(_add, spec).coalesce(1).mapInArrow(_add, spec).collect()
    side = features + k + 2
    sums = [sum((np.frombuffer(r["sums"], "<f8").reshape(side, side) for r in got if r["fold"] == f), np.zeros((side, side))) for f in (0, 1)]
    if not (sums[0] + sums[1]).any():
        return model

    def solve(s: np.ndarray) -> np.ndarray:
        a = s[:-1, :-1] + ridge * np.eye(side - 1)
        return np.linalg.solve(a, s[:-1, -1])

    scored = rows.mapInArrow(_raw(model, [solve(sums[0]), solve(sums[1])]), "raw double, y double")
    which = F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.4999)) + 0.5) * BINS / 2)
    bins = scored.groupBy(which.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("m"), F.count("y").alias("w")).orderBy("bin").collect()
    x, m, w = (np.array([float(r[c]) for r in bins]) for c in ("x", "m", "w"))
    model.beta, model.knots = solve(sums[0] + sums[1]), np.clip(x, -0.5, 1.5)
    model.level = isotonic(x, m, w)
    return model


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(_batch(b)))], ["id", "score"])

    return run


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s) of every row, as a table in the shared folder."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return keep(base.mapInArrow(_statistics, "id long, s array<double>"), "statistics")


def score_quality(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """Per row of stats: id_col, score, predicted."""
    out = stats.mapInArrow(_scores(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
