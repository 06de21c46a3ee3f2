"""Order statistics by counting: quantiles of a column, and medians of the differences of all pairs of rows, without making pairs.

Distinct values lie in blocks along their order. What blocks span says which pairs of blocks lie wholly below or above a bound; only
those that straddle it meet in tasks, and these are a few for each block. A search among the doubles then needs a few such counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..tables import keep
from .splits import placed

#: Blocks of values at most; the driver holds a table of pairs of blocks.
BLOCKS = 512
#: Bounds that one scan counts pairs for.
BOUNDS = 256


def _bounds(low: float, high: float, n: int) -> np.ndarray:
    """At most n doubles above low and up to high, which is the last; all of them where there are no more."""
    bits = lambda d: int(np.float64(d).view(np.int64))  # doubles of at least 0 have the order of their bits
    a, b = bits(low), bits(high)
    if b - a <= n:
        return np.arange(a + 1, b + 1, dtype=np.int64).view(np.float64)
    even = low + (high - low) * np.arange(1, n) / n  # by size first, then by bits where sizes round together
    even = np.unique(even[(even > low) & (even < high)])
    by_bits = np.array([a + (b - a) * i // n for i in range(1, n)], np.int64).view(np.float64)
    return np.append(even if len(even) >= n // 2 else by_bits, high)


def _below(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each a and its bound, how many of the rising b have b - a <= bound as doubles."""
    at = np.searchsorted(b, a + bound, "right")
    while True:  # a + bound and b - a round on their own
        back = (at > 0) & (b[np.maximum(at - 1, 0)] - a > bound)
        on = (at < len(b)) & (b[np.minimum(at, len(b) - 1)] - a <= bound)
        if not (back.any() or on.any()):
            return at
        at = at - back + on


class _Gaps:
    def __init__(self, df: DataFrame, key: str, col: str, blocks: int) -> None:
        rows = df.select(F.col(key).alias("k"), (F.col(col).cast("double") + 0.0).alias("v")).dropna(subset=["k"]).where("v IS NOT NULL")
        if not rows.where(F.isnan("v") | (F.abs("v") == float("inf"))).isEmpty():
            raise ValueError(f"{col} has values that are not finite")
        values = placed(rows.groupBy("v").agg(F.count(F.lit(1)).alias("w")), [F.col("v")])
        size = max(64, -(-values.count() // blocks))
        self.rows = keep(values.select("v", "w", F.expr(f"CAST(place DIV {size} AS INT)").alias("block")), "values")
        spans = sorted(self.rows.groupBy("block").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("own")).collect())  # at most `blocks`
        self.low, self.high = (np.array([r[c] for r in spans]) for c in ("low", "high"))
        n = np.array([r["n"] for r in spans], np.int64)
        p, q = np.triu_indices(len(spans))
        self.pairs = np.where(p == q, 0, n[p] * n[q])
        self.pairs[p == q] = [(int(r["n"]) ** 2 - int(r["own"])) // 2 for r in spans]
        self.p, self.q, self.least, self.most = p, q, np.maximum(0.0, self.low[q] - self.high[p]), self.high[q] - self.low[p]
        # pairs of rows of one key are no pairs; a key that does not repeat has none
        twice = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
        own = rows.join(twice, "k").groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
        a, b = own.select("k", F.col("v").alias("va"), F.col("w").alias("wa")), own.select("k", F.col("v").alias("vb"), F.col("w").alias("wb"))
        self.same = keep(a.join(b, "k").where("va < vb").groupBy((F.col("vb") - F.col("va")).alias("d")).agg(F.sum(F.col("wa") * F.col("wb")).alias("w")), "same")
        self.n_same = self.same.agg(F.sum("w")).first()[0] or 0
        self.n = int(self.pairs.sum()) - self.n_same

    def _met(self, cut: np.ndarray) -> GroupedData:
        """Both sides of the pairs of blocks in cut."""
        met = F.broadcast(self.rows.sparkSession.createDataFrame(list(zip(self.p[cut].tolist(), self.q[cut].tolist())), "p int, q int"))  # a few a block
        sides = [self.rows.join(met, F.col("block") == F.col(c)).select("p", "q", "v", "w", F.lit(i).alias("side")) for i, c in enumerate("pq")]
        return sides[0].unionByName(sides[1]).groupBy("p", "q")

    def counted(self, bounds: np.ndarray) -> np.ndarray:
        """How many pairs of rows of different keys and values differ by at most each of the rising bounds, in one scan."""
        sure = np.array([self.pairs[self.most <= t].sum() for t in bounds], np.int64)
        cut = (self.least <= bounds[-1]) & (self.most > bounds[0])
        if cut.any():

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("v")
                one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
                a, wa, b = one["v"].to_numpy(), one["w"].to_numpy(), two["v"].to_numpy()
                total = np.concatenate([[0], np.cumsum(two["w"].to_numpy())])
                start = total[np.searchsorted(b, a, "right")]  # within a block only what is greater
                open_ = np.nonzero((b[0] - a[-1] <= bounds) & (bounds < b[-1] - a[0]))[0]
                out, step = np.zeros(len(bounds), np.int64), max(1, (1 << 20) // len(a))
                for t in (open_[c : c + step] for c in range(0, len(open_), step)):
                    at = _below(np.tile(a, len(t)), b, np.repeat(bounds[t], len(a))).reshape(len(t), -1)
                    out[t] = np.maximum(0, total[at] - start) @ wa
                return pd.DataFrame({"t": np.arange(len(bounds)), "n": out})

            found = self._met(cut).applyInPandas(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()  # a number a bound
            for r in found:
                sure[r["t"]] += r["n"]
        if self.n_same:
            less = self.same.agg(*[F.coalesce(F.sum(F.when(F.col("d") <= float(t), F.col("w"))), F.lit(0)) for t in bounds]).first()
            sure -= np.array(less, np.int64)
        return sure

    def after(self, bound: float) -> float:
        """The smallest difference above bound, in one scan."""
        over = self.most > bound

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("v")
            a, b = (pdf.loc[pdf["side"] == i, "v"].to_numpy() for i in (0, 1))
            at = _below(a, b, np.full(len(a), bound))
            return pd.DataFrame({"d": (b[at[at < len(b)]] - a[at < len(b)])}).agg(["min"]).dropna()

        return self._met(over & (self.least <= self.most[over].min())).applyInPandas(run, "d double").agg(F.min("d")).first()[0]

    def place(self, k: int) -> tuple[float, int]:
        """(the k-th smallest difference, from 1; how many are not greater)."""
        by_least, by_most = np.argsort(self.least, kind="stable"), np.argsort(self.most, kind="stable")
        least = int(np.searchsorted(np.cumsum(self.pairs[by_least]), k))
        most = int(np.searchsorted(np.cumsum(self.pairs[by_most]), k + self.n_same))
        high = self.most[by_most[min(most, len(by_most) - 1)]]
        low = np.nextafter(self.least[by_least[min(least, len(by_least) - 1)]], -1.0)  # fewer than k lie at or below it
        low, n = max(0.0, low), None
        while True:
            bounds = _bounds(low, high, BOUNDS)
            counts = self.counted(bounds)
            at = int(np.searchsorted(counts, k))
            high, n = float(bounds[at]), int(counts[at])
            low = float(bounds[at - 1]) if at else low
            if np.nextafter(low, np.inf) >= high:
                return high, n


def order_statistics(df: DataFrame, col: str, ranks: list[int], bins: int = 4096) -> list[float]:
    """The values of col (finite, no nulls) at places from 0 in their order. A scan counts values by bins of a range and the next looks into the bins
    that hold a rank, as far as their least and greatest value; nothing is sorted or sent but counts."""
    rows = df.select(F.col(col).cast("double").alias("v"))
    found: dict[int, float] = {}
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    todo = [(span["low"], span["high"], 0, sorted(set(ranks)))]
    while todo:
        low, high, below, own = todo.pop()
        if low == high:
            found |= dict.fromkeys(own, low)
            continue
        share = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)  # halves do not overflow
        at = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
        counts = sorted(rows.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for r in counts:  # at most `bins`
            here = [k for k in own if below <= k < below + r["n"]]
            if here:
                todo.append((r["low"], r["high"], below, here))
            below += r["n"]
    return [found[k] for k in ranks]


def quantile(df: DataFrame, col: str, share: float) -> float | None:
    """The quantile of a column by linear interpolation, exact at any size; nulls are left out, None without values. NaN counts as the greatest value."""
    v = F.col(col).cast("double")
    kept = df.select(v.alias("v")).where("v IS NOT NULL")
    plain = kept.where(~F.isnan("v") & (F.abs("v") != float("inf")))
    small, n, large, nan = (x or 0 for x in kept.agg(*[F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("v") == -float("inf"), ~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v") == float("inf"), F.isnan("v"))]).first())
    if not small + n + large + nan:
        return None
    at = share * (small + n + large + nan - 1)
    ends = [int(at), min(int(at) + (at > int(at)), small + n + large + nan - 1)]
    inner = [k - small for k in ends if small <= k < small + n]
    told = dict(zip(inner, order_statistics(plain, "v", inner))) if inner else {}
    a, b = (told[k - small] if k - small in told else -float("inf") if k < small else float("inf") if k < small + n + large else float("nan") for k in ends)
    return a if a == b else a * (1 - (at - ends[0])) + b * (at - ends[0])


def median_gap(df: DataFrame, key: str, col: str, blocks: int = BLOCKS) -> float | None:
    """The median of |difference| over all pairs of rows of different keys whose values differ; None without such pairs.

    Exact, with the rounding of doubles; nulls are in no pair, values that are not finite raise.
    """
    gaps = _Gaps(df, key, col, blocks)
    if gaps.n <= 0:
        return None
    low, n = gaps.place((gaps.n + 1) // 2)
    if gaps.n % 2 or n > gaps.n // 2:
        return low
    return (low + (gaps.place(n + 1)[0] if gaps.n_same else gaps.after(low))) / 2
