"""Neighbour operators: exact k nearest neighbours by blocks, mid-points, embedding errors, applicability domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep

#: Points of a block; a task holds one block of queries and one of references.
BLOCK = 2048
#: Pivots at most; with more blocks than that a cell is met in parts.
PIVOTS = 1024
#: Rows of a chunk at most: a task holds one of queries and one of references beyond the own cell.
CHUNK = 65_536
#: Rows of each side that are compared at a time.
TILE = 2048


def _distances(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of all pairs as near as a query's k-th: a product finds them with some slack, ties included, differences measure them."""
    norm = (q * q).sum(1)[:, None] + (r * r).sum(1)[None]
    rough = norm - 2 * q @ r.T
    last = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < len(r) else np.full((len(q), 1), np.inf)
    i, j = np.nonzero(rough <= last + 1e-9 * norm)
    d = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        d[s] = np.sqrt(((q[i[s]] - r[j[s]]) ** 2).sum(1))
    return i, j, d


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, by_key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d, place) of the first k of each i by d, then key."""
    order = np.lexsort((by_key[j], d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k], d[place < k], place[place < k]


class _Cells:
    """Pivots, the radii of their cells, and what a query may find in them."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray) -> None:
        self.pivots, self.radius = pivots, radius
        self.between = np.sqrt(np.maximum(0, (pivots * pivots).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * pivots @ pivots.T))

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T))

    def reached(self, x: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether the cells other than its own may hold something as near to each of a few rows as its bound: their radius and the plane
        between the pivots tell."""
        d, between = self.to_pivots(x), self.between[at]
        mine = d[np.arange(len(d)), at][:, None]
        plane = (d * d - mine * mine) / (2 * np.maximum(between, 1e-300))
        least = np.maximum(np.where(between > 0, plane, 0), d - self.radius)
        go = (least <= bound[:, None] + 1e-6 * (1 + d.max(1))[:, None]) & np.isfinite(self.radius)  # products round
        go[np.arange(len(d)), at] = False
        return go


def _far(left: pa.Table, right: pa.Table, cells: _Cells, k: int, skip_self: bool) -> pa.Table:
    """(i, j, d): for each query (id, v, cell, bound) of a chunk its k nearest among a chunk of references (id, v, cell), as far as its bound,
    in cells other than its own. TILE queries meet TILE references of a cell at a time."""
    names = ["i", "j", "d"]
    mine, theirs = left.column("id").to_pandas().to_numpy(), right.column("id").to_pandas().to_numpy()
    found = []
    if left.num_rows and right.num_rows:
        x, r, own, cell, bounds = _matrix(left), _matrix(right), left.column("cell").to_numpy(), right.column("cell").to_numpy(), left.column("bound").to_numpy()
        by_key = np.argsort(np.argsort(theirs, kind="stable"), kind="stable")
        in_cells, by_cell = np.argsort(cell, kind="stable"), np.argsort(own, kind="stable")
        cs, begins = np.unique(cell[in_cells], return_index=True)
        runs = [(c, in_cells[p : min(p + TILE, e)]) for c, b, e in zip(cs, begins, [*begins[1:], len(cell)]) for p in range(b, e, TILE)]
        for tile in (by_cell[a : a + TILE] for a in range(0, len(x), TILE)):
            q, bound = x[tile], bounds[tile].copy()
            norm, go = (q * q).sum(1), cells.reached(q, own[tile], bound)
            held: list[tuple[np.ndarray, ...]] = []
            n = 0

            def settle() -> None:
                nonlocal held, n
                i, j, d, place = _first(*(np.concatenate(c) for c in zip(*held)), by_key, k)
                bound[i[place == k - 1]] = np.minimum(bound[i[place == k - 1]], d[place == k - 1])
                held, n = [(i, j, d)], 0

            for c, run in runs:
                rows = np.nonzero(go[:, c])[0]
                if not len(rows):
                    continue
                z = r[run]
                norms = (z * z).sum(1)
                rough = norm[rows][:, None] + norms - 2 * q[rows] @ z.T
                slack = 1e-9 * (norm[rows] + norms.max())
                last = bound[rows] ** 2 + slack
                near = rough <= last[:, None]
                many = np.nonzero(near.sum(1) > 8 * k)[0]
                if len(many) and k + skip_self < len(run):
                    near[many] &= rough[many] <= (np.partition(rough[many], k + skip_self - 1, axis=1)[:, k + skip_self - 1] + 2 * slack[many])[:, None]
                del rough
                for some in np.array_split(np.arange(len(rows)), 1 + near.sum() // (1 << 18)):  # ties may be many
                    i, j = np.nonzero(near[some])
                    i, j = rows[some[i]], run[j]
                    if skip_self:
                        other = mine[tile[i]] != theirs[j]
                        i, j = i[other], j[other]
                    if len(i):
                        d = np.concatenate([np.sqrt(((q[i[a : a + (1 << 15)]] - r[j[a : a + (1 << 15)]]) ** 2).sum(1)) for a in range(0, len(i), 1 << 15)])
                        held.append((i, j, d))
                        n += len(i)
                    if n > 4 * k * len(tile):
                        settle()
            if held:
                settle()
                i, j, d = held[0]
                found.append((mine[tile[i]], theirs[j], d))
    if not found:
        return pa.table([pa.array([], left.schema.field("id").type), pa.array([], right.schema.field("id").type), pa.array([], pa.float64())], names)
    i, j, d = (np.concatenate(c) for c in zip(*found))
    return pa.table([pa.array(i, left.schema.field("id").type), pa.array(j, right.schema.field("id").type), pa.array(d)], names)


def nearest(queries: DataFrame, references: DataFrame, k: int, key: str = "id", vector: str = "v", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(i, j, d, rank): the k nearest references of every query, by distance, then key; never a row with the query's own key if skip_self.

    Exact. References are dealt to cells, those of their nearest pivot; pivots are references of least hash, about one a block and
    PIVOTS at most. A query first meets its own cell, in parts where that outgrows a block, which bounds how far its neighbours can be;
    then the chunks of cells that may hold something as near. A row goes once to each chunk (a dozen, of CHUNK rows at most), not to
    each cell, and a task meets one chunk of queries with one of references in tiles, so what it holds does not grow with the table. Of equal
    references only those that a query can return are met. In many dimensions little is pruned: the products are those of all pairs.
    """
    kind = queries.schema[key].dataType.simpleString()
    plain = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = plain(references)
    for by, most in ((["v", "id"], k), (["v"], 2 * k if skip_self else k)):  # a query leaves out one key
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= most).drop("n")
    first = keep(first, "references")
    n = first.count()
    if n == 0:
        return queries.sparkSession.createDataFrame([], f"i {kind}, j {kind}, d double, rank int")
    few = first.orderBy(F.xxhash64(F.lit(1), "id")).limit(min(PIVOTS, -(-n // block))).collect()
    deal = _Cells(np.array([r["v"] for r in few]), np.zeros(len(few)))

    def assigned(df: DataFrame) -> DataFrame:
        def run(batches):
            for whole in batches:
                for pdf in (whole.iloc[a : a + TILE] for a in range(0, len(whole), TILE)):
                    d = deal.to_pivots(np.stack(pdf["v"].to_numpy()))
                    cell = d.argmin(1)
                    yield pd.DataFrame({"id": pdf["id"].to_numpy(), "v": pdf["v"].to_numpy(), "cell": cell, "far": d[np.arange(len(d)), cell]})

        said = f"id {df.schema['id'].dataType.simpleString()}, v array<double>, cell int, far double"
        return keep(df.mapInPandas(run, said), "cells")

    own, there = assigned(plain(queries)), assigned(first)
    of = {r["cell"]: (r["n"], r["r"]) for r in there.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}  # a cell a row
    parts = {c: -(-m // block) for c, (m, _) in of.items()}
    found = keep(_met(own.where(F.col("cell").isin(list(of))).select("id", "v", "cell"), there, parts, k, skip_self, block), "near")
    if len(few) > 1:
        bound = found.groupBy("i").agg(F.sort_array(F.collect_list("d")).alias("d")).select(F.col("i").alias("id"), F.get("d", F.lit(k - 1)).alias("bound"))
        cells = _Cells(deal.pivots, np.array([of.get(c, (0, -np.inf))[1] for c in range(len(few))]))
        found = found.unionByName(_reached(own.join(bound, "id", "left"), there, cells, {c: m for c, (m, _) in of.items()}, k, skip_self, min(CHUNK, max(block, -(-n // 12)))))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def _by(column: str, m: dict[int, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(int(x)) for pair in m.items() for x in pair])[F.col(column)], F.lit(0)) if m else F.lit(0)


def _reached(own: DataFrame, there: DataFrame, cells: _Cells, sizes: dict[int, int], k: int, skip_self: bool, chunk: int) -> DataFrame:
    """(i, j, d) of the queries (id, v, cell, bound) and what they may find in other cells."""
    # cells beside each other fill a chunk, along the axis on which the pivots differ most; a cell above a chunk is one of its own, in parts
    centred = cells.pivots - cells.pivots.mean(0)
    along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    begin, parts, at, full = {}, {}, -1, chunk
    for c in sorted(sizes, key=lambda c: along[c]):
        parts[c] = -(-sizes[c] // chunk)
        if parts[c] > 1 or full + sizes[c] > chunk:
            at, full = at + 1, 0
        begin[c], full = at, full + sizes[c]
        if parts[c] > 1:
            at, full = at + parts[c] - 1, chunk
    chunks = {c: list(range(begin[c], begin[c] + parts[c])) for c in sizes}
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for pdf in (whole.iloc[a : a + TILE] for a in range(0, len(whole), TILE)):
                go = cells.reached(np.stack(pdf["v"].to_numpy()), pdf["cell"].to_numpy(), pdf["bound"].fillna(np.inf).to_numpy(float))
                reach = np.zeros((len(pdf), at + 1), bool)
                for c in chunks:
                    reach[:, chunks[c]] |= go[:, [c]]
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "v": pdf["v"].to_numpy(), "cell": pdf["cell"].to_numpy(), "bound": pdf["bound"].fillna(np.inf).to_numpy(float), "reach": [np.nonzero(r)[0].astype(np.int32) for r in reach]})

    part = lambda n: F.pmod(F.xxhash64(F.lit(2), "id"), n)
    told = own.select("id", "v", "cell", "bound").mapInPandas(run, f"id {kind}, v array<double>, cell int, bound double, reach array<int>")
    told = keep(told.withColumn("at", _by("cell", begin)), "reached")
    counts = {r["at"]: -(-r["count"] // chunk) for r in told.groupBy("at").count().collect()}  # a chunk a row
    told = told.withColumn("a", (F.col("at") + F.lit(at + 1) * part(_by("at", counts))).cast("long"))
    q = told.select("id", "v", "cell", "bound", "a", F.explode("reach").alias("b"))
    pairs = told.select(F.col("a").alias("of"), F.explode("reach").alias("to")).distinct()  # of chunks
    r = there.select("id", "v", "cell", (_by("cell", begin) + part(_by("cell", parts))).cast("int").alias("chunk")).join(F.broadcast(pairs), F.col("chunk") == F.col("to"))
    id_of = lambda df: df.schema["id"].dataType.simpleString()
    meet = lambda left, right: _far(left, right, cells, k, skip_self)
    return q.groupBy("a", "b").cogroup(r.select("id", "v", "cell", "of", "to").groupBy("of", "to")).applyInArrow(meet, f"i {id_of(q)}, j {id_of(r)}, d double")


def _met(queries: DataFrame, references: DataFrame, parts: dict[int, int], k: int, skip_self: bool, block: int) -> DataFrame:
    """(i, j, d): for each query (id, v, cell) of a written table its k nearest in every part of that cell."""
    blocks = {r["cell"]: -(-r["count"] // block) for r in queries.groupBy("cell").count().collect()}  # a cell a row
    number = lambda m: _by("cell", m)
    deal = lambda n: F.pmod(F.xxhash64(F.lit(2), "id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = queries.where(number(parts) > 0).select("id", "v", "cell", deal(number(blocks)).alias("bq"), all_of(number(parts)).alias("br"))
    r = references.where(number(blocks) > 0).select("id", "v", "cell", all_of(number(blocks)).alias("bq"), deal(number(parts)).alias("br"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        i, j, d = _distances(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), k + skip_self)
        mine, theirs = a["id"].to_numpy(), b["id"].to_numpy()
        if skip_self:
            other = mine[i] != theirs[j]
            i, j, d = i[other], j[other], d[other]
        by_key = np.argsort(np.argsort(theirs, kind="stable"), kind="stable")
        order = np.lexsort((by_key[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        return pd.DataFrame({"i": mine[i], "j": theirs[j], "d": d})[place < k]

    side = lambda df: df.schema["id"].dataType.simpleString()
    at = ("cell", "bq", "br")
    return q.groupBy(*at).cogroup(r.groupBy(*at)).applyInPandas(pair, f"i {side(queries)}, j {side(references)}, d double")


def midpoints(points: DataFrame, neighbours: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    """(i, j, rank, v, y): the mean of each point and each of its neighbours."""
    a = points.select(F.col(key).alias("i"), F.col(vector).alias("va"), F.col(y).alias("ya"))
    b = points.select(F.col(key).alias("j"), F.col(vector).alias("vb"), F.col(y).alias("yb"))
    both = neighbours.join(a, "i").join(b, "j")
    return both.select("i", "j", "rank", F.zip_with("va", "vb", lambda x, z: (x + z) / 2).alias("v"), ((F.col("ya") + F.col("yb")) / 2).alias("y"))


def k3n_error(points: DataFrame, key: str, original: str, mapped: str, k: int) -> DataFrame:
    """(error): how much further the neighbours of the original space are in the mapped space than its own neighbours.

    Distances of 0 in the mapped space, a point's own included, count as its smallest positive distance there.
    """
    near = nearest(points, points, k, key, original).select("i", "j")
    own = nearest(points, points, k + 1, key, mapped)
    m = points.select(F.col(key).alias("i"), F.col(mapped).cast("array<double>").alias("a"))
    n = m.select(F.col("i").alias("j"), F.col("a").alias("b"))
    raw = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, z: (x - z) * (x - z)), F.lit(0.0), lambda s, x: s + x))
    there = near.join(m, "i").join(n, "j").select("i", raw.alias("d"))
    low = own.where("d > 0").groupBy("i").agg(F.min("d").alias("low"))
    lifted = F.when(F.col("d") == 0, F.col("low")).otherwise(F.col("d"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d"))
    there = there.join(low, "i").select("i", lifted.alias("d")).select("i", "d", rank.alias("r"))
    mine = own.where(F.col("rank") <= k).join(low, "i").select("i", lifted.alias("e"), F.col("rank").alias("r"))
    # the point itself (lifted from 0) comes first or among equals in its own row: the k behind it are compared
    return there.join(mine, ["i", "r"]).agg((F.sum((F.col("d") - F.col("e")) / F.col("e")) / F.countDistinct("i") / k).alias("error"))


def knn_domain(neighbours: DataFrame, rate_of_outliers: float, threshold: float | None = None) -> tuple[DataFrame, float]:
    """((id, domain), threshold): 1 / (mean distance + 1) less its quantile; below 0 is outside. Fit without a threshold, predict with it."""
    score = neighbours.groupBy(F.col("i").alias("id")).agg((1 / (F.avg("d") + 1)).alias("s"))
    if threshold is None:
        threshold = score.agg(F.percentile("s", rate_of_outliers)).first()[0]
    return score.select("id", (F.col("s") - F.lit(threshold)).alias("domain")), threshold


def local_outlier_factor(neighbours: DataFrame) -> DataFrame:
    """(id, lof) from each point's k nearest (i, j, d, rank) within one table."""
    reach = neighbours.groupBy("i").agg(F.max("d").alias("kd")).select(F.col("i").alias("j"), "kd")
    lrd = neighbours.join(reach, "j").groupBy("i").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    other = lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j"))
    ratio = neighbours.join(other, "j").join(lrd, "i")
    return ratio.groupBy(F.col("i").alias("id")).agg(F.avg(F.col("lrd_j") / F.col("lrd")).alias("lof"))


def similarity(d: Column, lam: float, *partition: str) -> Column:
    """exp(-d / std(d) / lambda) within a query's rows."""
    return F.exp(-d / F.stddev_samp(d).over(Window.partitionBy(*partition)) / lam)
