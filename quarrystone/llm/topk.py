"""Exact top-k inner products: a ball tree per shard, branch and bound, the kth score shared between shards.

Shards are cells around pivots, so their root balls differ.  A block of queries first searches the shard of the
largest upper bound, then, with the kth scores found there, the few next ones, then the rest; before each wave the root
balls alone say which (block, shard) pairs are still needed, and only those move a tree.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 64
#: Most pivots (vectors that the driver holds), shards of one table of root balls, and shards of the second wave.
PIVOTS, ROOTS, NEXT = 256, 1024, 4
#: Integer products stay exact in float64 below this; beyond, a vector is wide.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: odd(x.cast("double")))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, exact for every finite double (scale is a power of two)."""
    big = np.abs(x) >= 2.0**53
    out = np.floor(np.where(big, 0.0, x) * scale).astype(np.int64).astype(object)
    if big.any():
        out[big] = [int(v) * scale for v in x[big].tolist()]
    return out


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) divided by a power of two so that no component is over 1."""
    big = np.abs(x) >= 2.0**53
    e = int(np.frexp(np.abs(x).max(initial=1.0))[1])
    return np.ldexp(np.floor(np.where(big, 0.0, x) * scale) / scale, -e) + np.ldexp(np.where(big, x, 0.0), -e)


def wide_search(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int, scale: int) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each query in integers without bounds: float64 with its error picks who is multiplied out."""
    approx, other = scaled(q, scale), scaled(x, scale)
    norm = np.sqrt((approx**2).sum(axis=1)) * np.sqrt((other**2).sum(axis=1)).max(initial=0.0)
    slack = norm * 2.0**-48 * x.shape[1] + 2.0**-1000
    whole_q, whole_x = integers(q, scale), integers(x, scale)
    out = []
    for i in range(len(q)):
        s = other @ approx[i]
        s[uids == own[i]] = -np.inf
        kth = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= kth - 2 * slack[i]) & (s > -np.inf))
        exact = [(sum(a * b for a, b in zip(whole_q[i], whole_x[j])), int(ids[j])) for j in near.tolist()]
        out.append(sorted(exact, key=lambda z: (-z[0], z[1]))[:k])
    return out


def sort_key(n: int) -> str:
    """A string that sorts as the integer does, whatever its size."""
    if n >= 0:
        return f"p{len(str(n)):04d}{n}"
    digits = str(-n)
    return f"n{9999 - len(digits):04d}{''.join(str(9 - int(c)) for c in digits)}"


class BallTree:
    """Balls over the rows of ``x``: ``center``, ``radius``, children, and for leaves a range of ``order``.

    A ball of equal vectors is never split; of its rows only the ``keep`` smallest ids can be among any query's
    top keep - 1 besides the query's own row, so the rest is left out, exactly.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, uids: np.ndarray, keep: int) -> None:
        self.center, self.radius, self.kids, self.rows = [], [], [], []
        self.x, self.ids, self.uids = x, ids, uids
        self._build(np.arange(len(x)), keep)
        self.center, self.radius = np.array(self.center), np.array(self.radius)

    def _build(self, rows: np.ndarray, keep: int) -> int:
        v = self.x[rows]
        low, high = v.min(axis=0), v.max(axis=0)
        c = v.mean(axis=0)
        at = len(self.radius)
        self.center.append(c)
        self.radius.append(float(np.sqrt(((v - c) ** 2).sum(axis=1).max())))
        self.kids.append(None)
        self.rows.append(None)
        j = int(np.argmax(high - low))
        if high[j] == low[j]:
            self.rows[at] = rows[np.lexsort((self.uids[rows], self.ids[rows]))][:keep]
        elif len(rows) <= LEAF:
            self.rows[at] = rows
        else:
            go = v[:, j] <= np.median(v[:, j])
            if go.all():
                go = v[:, j] < high[j]
            self.kids[at] = (self._build(rows[go], keep), self._build(rows[~go], keep))
        return at

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Top-k scores and ids of each query (rows of ``q``); ``bound`` holds scores known to be reached.

        Nodes are taken in the order of their largest upper bound q.c + |q| r; a query leaves a node whose bound
        is below its kth score.  Unfilled places have score -inf.
        """
        n = len(q)
        scores = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        norm = np.sqrt((q**2).sum(axis=1))
        upper = q @ self.center.T + norm[:, None] * self.radius[None, :]
        upper += 1e-9 * np.abs(upper) + 1e-6
        heap = [(-upper[:, 0].max(initial=-np.inf), 0, np.arange(n))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[upper[who, node] >= np.maximum(scores[who, -1], bound[who])]
            if not len(who):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-upper[who, kid].max(), kid, who))
                continue
            rows = self.rows[node]
            s = q[who] @ self.x[rows].T
            s[own[who][:, None] == self.uids[rows][None, :]] = -np.inf
            better = s.max(axis=1) >= np.maximum(scores[who, -1], bound[who])
            if not better.any():
                continue
            who, s = who[better], s[better]
            alls = np.concatenate([scores[who], s], axis=1)
            alli = np.concatenate([ids[who], np.broadcast_to(self.ids[rows], s.shape)], axis=1)
            alli = np.where(alls == -np.inf, np.iinfo(np.int64).max, alli)
            best = np.lexsort((alli, -alls), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(alls, best, 1), np.take_along_axis(alli, best, 1)
        return scores, ids


def below(n: int) -> float:
    """A double that is at most the integer."""
    if n < -(10**300):
        return -np.inf
    f = float(min(n, 10**300))
    return f - abs(f) * 1e-15


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest integer type that holds them: what a shard ships."""
    top = np.abs(x).max(initial=0.0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


FOUND = "block string, query_uid long, query_id long, vec_id long, score long, low double, sortable string"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``.

    A query's own row is left out; other rows with its id are not.  Ties go to the smaller id.  Vectors that are
    null or hold null or non-finite components take no part, nor do null ids; vectors meet only vectors of their
    own dimension; dimension 0 takes no part.  Fewer than k candidates give fewer rows.  Other columns are
    ignored; an empty table gives no rows.  Every finite component counts exactly: vectors whose products could
    leave float64's whole numbers are wide, and pairs with one are multiplied out in unbounded integers.  A score
    beyond a long is ranked exactly and shown as the largest or smallest long.

    Rows are dealt to cells around at most PIVOTS pivots (the rows of smallest hash), cells to shards of about
    SHARD_ROWS, and each shard gets one ball tree.  Queries are dealt to blocks by their cell.
    """
    v = F.col(vec_col)
    base = vectors.where(F.col(id_col).isNotNull() & usable(v))
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) * scale + 1.0
    base = base.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("x"),
        F.size(v).alias("dim"), (top * top * F.size(v) >= EXACT).alias("wide"),
    )
    base = vectors_stored = written(base, "vectors")
    n_shards = max(1, -(-base.count() // SHARD_ROWS))
    some = base.orderBy(F.xxhash64("uid"), "uid").limit(min(PIVOTS, n_shards)).select("dim", "x").collect()
    pivots = {d: np.array([r["x"] for r in some if r["dim"] == d]) for d in {r["dim"] for r in some}}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    c = pivots[d]
                    with np.errstate(all="ignore"):
                        cell[at] = np.argmax(_matrix(pa.chunked_array([batch["x"].take(pa.array(at))])) @ c.T - (c**2).sum(axis=1) / 2, axis=1)
            yield batch.append_column("cell", pa.array(cell))

    base = base.mapInArrow(cells, "uid long, vec_id long, x array<double>, dim int, wide boolean, cell int")
    cell = ["dim", "wide", "cell"]

    def dealt(rows: DataFrame, most: int, out: str) -> DataFrame:
        """Rows of a cell in parts of about ``most``."""
        parts = rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts"))
        name = F.concat_ws("/", *cell, F.pmod(F.xxhash64("uid"), F.col("parts")))
        return rows.join(parts, cell).withColumn(out, name)

    def build(t: pa.Table) -> pa.Table:
        ids, uids, x, wide = t["vec_id"].to_numpy(), t["uid"].to_numpy(), _matrix(t["x"]), t["wide"][0].as_py()
        if wide:
            tree, center, radius = (x, ids, uids), x[0], float("inf")
        else:
            tree = BallTree(np.floor(x * scale), ids, uids, k + 1)
            center, radius = tree.center[0], float(tree.radius[0])
            tree.x = _small(tree.x)
        first = {c: t[c].slice(0, 1) for c in ("dim", "wide", "shard")}
        return pa.table(first | {"center": pa.array([center.tolist()]), "radius": pa.array([radius]), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    shards = dealt(base, SHARD_ROWS, "shard").groupBy("dim", "wide", "shard")
    shards = written(shards.applyInArrow(build, "dim int, wide boolean, shard string, center array<double>, radius double, tree binary"), "ball-trees")

    def block(t: pa.Table) -> pa.Table:
        wide, x = t["wide"][0].as_py(), _matrix(t["x"])
        got = pickle.dumps((t["vec_id"].to_numpy(), t["uid"].to_numpy(), x if wide else _small(np.floor(x * scale))), protocol=5)
        return pa.table({c: t[c].slice(0, 1) for c in ("dim", "wide", "block")} | {"queries": pa.array([got], pa.binary())})

    blocks = dealt(base.where(F.col("vec_id") % every == 0), BLOCK_QUERIES, "block").groupBy("dim", "wide", "block")
    blocks = written(blocks.applyInArrow(block, "dim int, wide boolean, block string, queries binary"), "queries")

    def pack_roots(t: pa.Table) -> pa.Table:
        got = pickle.dumps((t["shard"].to_pylist(), _matrix(t["center"]), t["radius"].to_numpy()), protocol=5)
        return pa.table({"dim": t["dim"].slice(0, 1), "roots": pa.array([got], pa.binary())})

    groups = F.pmod(F.xxhash64("shard"), F.lit(-(-n_shards // ROOTS))).alias("g")
    roots = shards.select("dim", "shard", "center", "radius", groups).groupBy("dim", "g")
    roots = written(roots.applyInArrow(pack_roots, "dim int, roots binary"), "roots")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (block, shard) pairs that some query still needs, and the mean of their upper bounds."""
        for t in batches:
            for i in range(t.num_rows):
                (_, uid, q), (names, center, radius) = pickle.loads(t["queries"][i].as_py()), pickle.loads(t["roots"][i].as_py())
                known = pickle.loads(t["known"][i].as_py()) if t["known"][i].is_valid else {}
                with np.errstate(all="ignore"):
                    wide = t["wide"][i].as_py()
                    q = q.astype(np.float64) * (scale if wide else 1)
                    long, far = np.sqrt((q**2).sum(axis=1))[:, None], (np.sqrt((center**2).sum(axis=1)) + radius)[None, :]
                    upper = q @ center.T + long * radius[None, :]
                    upper += 1e-9 * long * far + np.sqrt(q.shape[1]) * far * wide + 1e-6
                    skip = upper < np.array([known.get(u, -np.inf) for u in uid.tolist()])[:, None]
                    promise = np.nan_to_num(upper).mean(axis=0)
                at = np.flatnonzero(~skip.all(axis=0))
                columns = [pa.array([t["block"][i].as_py()] * len(at), pa.string()), pa.array([names[j] for j in at.tolist()], pa.string()), pa.array(promise[at])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "promise"])

    ranked_by = ["sortable", "score"]

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_uid").orderBy(*[F.col(c).desc() for c in ranked_by], "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def pack(t: pa.Table) -> pa.Table:
        known = pickle.dumps(dict(zip(t["query_uid"].to_pylist(), t["kth"].to_pylist())), protocol=5)
        return pa.table({"block": t["block"].slice(0, 1), "known": pa.array([known], pa.binary())})

    def kth_scores(found: DataFrame) -> DataFrame:
        kth = best(found).where(F.col("rank") == k).select("block", "query_uid", F.col("low").alias("kth"))
        return written(kth.groupBy("block").applyInArrow(pack, "block string, known binary"), "kth")

    exact_only = not vectors_stored.where("wide").isEmpty()  # then all scores carry a sortable string

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                tree, (qid, uid, q) = pickle.loads(t["tree"][i].as_py()), pickle.loads(t["queries"][i].as_py())
                known = pickle.loads(t["known"][i].as_py()) if t["known"][i].is_valid else {}
                wide_q, wide_x = t["wide"][i].as_py(), isinstance(tree, tuple)
                if wide_q or wide_x:
                    x, ids, uids = tree if wide_x else (tree.x.astype(np.float64) / scale, tree.ids, tree.uids)
                    lists = wide_search(q if wide_q else q.astype(np.float64) / scale, uid, x, ids, uids, k, scale)
                    flat = [(a, s, j) for a, one in enumerate(lists) for s, j in one]
                    a = np.array([f[0] for f in flat], np.int64)
                    scores, near = [f[1] for f in flat], [f[2] for f in flat]
                    low = [below(s) for s in scores]
                else:
                    tree.x = tree.x.astype(np.float64)
                    s, ids = tree.search(q.astype(np.float64), uid, k, np.array([known.get(u, -np.inf) for u in uid.tolist()]))
                    a, b = np.nonzero(s > -np.inf)
                    low, near, scores = s[a, b].tolist(), ids[a, b].tolist(), s[a, b].astype(np.int64).tolist()
                keys = [sort_key(x) for x in scores] if exact_only else [""] * len(scores)
                shown = [max(-LONG - 1, min(LONG, x)) for x in scores]
                columns = [pa.array([t["block"][i].as_py()] * len(a), pa.string()), pa.array(uid[a]), pa.array(qid[a]), pa.array(near, pa.int64())]
                columns += [pa.array(shown, pa.int64()), pa.array(low, pa.float64()), pa.array(keys, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "query_uid", "query_id", "vec_id", "score", "low", "sortable"])

    trees = shards.select("dim", "shard", "tree")
    known = blocks.select("block", F.lit(None).cast("binary").alias("known"))
    done, found, stored = None, None, [vectors_stored, blocks, shards, roots]
    for wave, most in enumerate((1, NEXT, None)):
        pairs = blocks.join(known, "block", "left").join(roots, "dim").select("block", "wide", "queries", "known", "roots")
        pairs = pairs.mapInArrow(bounds, "block string, shard string, promise double")
        if done is not None:
            pairs = pairs.join(done, ["block", "shard"], "left_anti")
        if most:
            w = Window.partitionBy("block").orderBy(F.col("promise").desc(), "shard")
            pairs = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
        pairs = written(pairs.select("block", "shard"), "pairs")
        todo = pairs.join(blocks, "block").join(known, "block", "left").join(trees, ["dim", "shard"]).select("block", "wide", "queries", "known", "tree")
        got = written(todo.mapInArrow(search, FOUND), "found")
        found = got if found is None else found.unionByName(got)
        done = pairs if done is None else done.unionByName(pairs)
        stored += [pairs, got]
        if n_shards == 1 or wave == 2:
            break
        known = kth_scores(found)
        stored.append(known)
    result = written(best(found).select("query_id", "rank", "vec_id", "score"), "top-k")
    dropped(*stored)
    return result
