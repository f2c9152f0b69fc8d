"""Nearest neighbours by a block matrix join of int8 tiles.

Every vector is scaled to length one and rounded to int8 where it is read; what is shuffled to the
blocks are these bytes with a scale and the length of what rounding lost. Queries are dealt into
blocks and distinct candidates into groups; each (group, block) cell is one task's product. Tile
products, exact sums of whole numbers, give every cosine up to a bound made of the rounding errors'
lengths. A pair survives its cell, and then all cells, if its upper bound reaches the k-th best lower
bound of its query. Only for survivors are the vectors themselves fetched, to compute the cosine in
double precision, and the best k are kept by a window limit, a heap in each task. The bounds are
proven, so the result is the exact one.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither do
rows without an id; vectors of different length are never compared. Rows with the query's own id
are its own; equal rows of one id count once, and of different vectors under one id the one with the
smallest digest does; ties go to the smaller id. Of equal vectors the k + 1 smallest ids stand for
all, so that a vector that a third of the rows have is one candidate.
Other columns are not looked at, whatever their names.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars.sources.staging import stage

TILE = 1024
EXACT = 1024  # components whose int8 products add up exactly in float32: 127^2 x 1024 < 2^24
CELLS = 1 << 20  # components that a task rounds at a time
INTS = "vec_id long, dim int, digest binary, q binary, scale double, lost double, v array<double>"
PAIRS = "query_id long, rep long, low double, high double"


def usable(table, vec_id="vec_id", vector="embedding"):
    """Rows that take part: id and vector in double."""
    return (
        table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .filter(_fine("v"))
    )


def _fine(name):
    ok = F.forall(F.col(name), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return ok & F.exists(F.col(name), lambda x: x != 0)


def _scaled(rows):
    """Rows times powers of two that bring their largest component near one: no square over- or underflows, no bit is lost."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _int8(unit):
    """Whole numbers of at most 127, the scale of each row, and the length of what rounding lost."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    lost = np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.int8), scale, lost


def _rounded(batches):
    """The int8 form of every vector, with a digest of the vector and the vector itself, scaled by a power of two."""
    for batch in batches:
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        for dim in sorted(set(sizes.tolist())):
            own = np.flatnonzero(sizes == dim)
            for a in range(0, len(own), max(1, CELLS // dim)):
                at = pa.array(own[a : a + max(1, CELLS // dim)])
                raw = vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim) + 0.0
                rows = _scaled(raw)
                whole, scale, lost = _int8(rows / np.sqrt((rows**2).sum(axis=1))[:, None])
                bounds = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column(0).take(at), "dim": pa.array(np.full(len(at), dim, np.int32)),
                    "digest": pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw], pa.binary()),
                    "q": pa.array([r.tobytes() for r in whole], pa.binary()), "scale": scale, "lost": lost,
                    "v": pa.ListArray.from_arrays(bounds, pa.array(rows.ravel())),
                })


def _products(left, right):
    """Products of whole numbers of at most 127, exact: float32 within parts of the components, float64 over them."""
    total = (left[:, :EXACT] @ right[:, :EXACT].T).astype(np.float64)
    for c in range(EXACT, left.shape[1], EXACT):
        total += left[:, c : c + EXACT] @ right[:, c : c + EXACT].T
    return total


def survivors(queries, candidates, k):
    """Pairs of a cell whose upper bound reaches the k-th best lower bound of their query: places, low and high.

    Both sides are (ids, int8 rows, scales, lost lengths); candidates end with whether the id is the only one.
    """
    (q_ids, q, q_scale, q_lost), (c_ids, c, c_scale, c_lost, single) = queries, candidates
    q = q.astype(np.float32)
    best = np.full((len(q), k), -np.inf)
    held = []
    for a in range(0, len(c), TILE):
        b = min(a + TILE, len(c))
        about = _products(q, c[a:b].astype(np.float32)) * q_scale[:, None] * c_scale[None, a:b]
        # |x.y - x'.y'| <= |x'||y - y'| + |x - x'||y|, where |x'| <= 1 + |x - x'| and |y| = 1.
        slack = (1 + q_lost)[:, None] * c_lost[None, a:b] + q_lost[:, None] + 1e-9
        own = single[None, a:b] & (c_ids[None, a:b] == q_ids[:, None])
        low = np.where(own, -np.inf, about - slack)
        best = -np.partition(-np.c_[best, low], k - 1, axis=1)[:, :k]
        at = np.nonzero(~own & (about + slack >= best.min(axis=1)[:, None]))
        held.append((at[0], at[1] + a, low[at], (about + slack)[at]))
    rows, places, low, high = (np.concatenate(x) for x in zip(*held))
    kept = high >= best.min(axis=1)[rows]
    return rows[kept], places[kept], low[kept], high[kept]


def _cell(k):
    def load(table, ids):
        numbers = lambda c: table.column(c).to_numpy()
        whole = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(table), -1)
        return numbers(ids), whole, numbers("scale"), numbers("lost")

    def run(candidates, queries):
        if not len(candidates) or not len(queries):
            return pa.table({name: pa.array([], kind) for name, kind in (("query_id", pa.int64()), ("rep", pa.int64()), ("low", pa.float64()), ("high", pa.float64()))})
        left, right = load(queries, "vec_id"), load(candidates, "rep")
        rows, places, low, high = survivors(left, (*right, candidates.column("single").to_numpy()), k)
        return pa.table({"query_id": left[0][rows], "rep": right[0][places], "low": low, "high": high})

    return run


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def nearest(table, is_query, k=5, group_rows=8192, block_rows=4096, **columns):
    """The k nearest rows by cosine of every row for which ``is_query`` (a column of vec_id) holds."""
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("digest"))
    rows = usable(table, **columns).mapInArrow(_rounded, INTS).withColumn("_r", one).filter("_r = 1").drop("_r")
    copy = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    rows = stage(rows)
    held = rows.drop("v").withColumn("_r", copy).filter(F.col("_r") <= k + 1)
    reps = held.groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("dim", "q", "scale", "lost")]
    )
    reps = stage(reps.withColumn("single", F.col("m") == 1).drop("m"))
    queries = rows.filter(is_query).select("vec_id", "dim", "q", "scale", "lost")
    n, n_queries = reps.count(), queries.count()
    groups, blocks = max(1, math.ceil(n / group_rows)), max(1, math.ceil(n_queries / block_rows))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    left = reps.select("dim", "rep", "single", "q", "scale", "lost", deal("rep", groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), deal("vec_id", blocks).alias("b"))
    found = left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInArrow(_cell(k), PAIRS)

    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"))))
    of_query = Window.partitionBy("query_id")
    floor = F.when(F.max("_r").over(of_query) >= k, F.min(F.when(F.col("_r") <= k, F.col("low"))).over(of_query))
    kept = ranked.withColumn("_floor", floor).filter("_floor IS NULL OR high >= _floor").select("query_id", "rep")
    a = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("a"))
    b = rows.select(F.col("vec_id").alias("rep"), F.col("v").alias("b"), "digest")
    score = _dot("a", "b") / (F.sqrt(_dot("a", "a")) * F.sqrt(_dot("b", "b")))
    scored = kept.join(b, "rep").join(a, "query_id").select("query_id", "digest", score.alias("score"))
    named = scored.join(held.select("digest", "vec_id"), "digest").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
