"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, floor(scale * c). The covariance is taken over the fit list, every
distinct vector once, so copies do not weigh. Each pass over the list centres the rows (a whole part
of the mean is taken off exactly), solves them through the triangular factors found so far and adds
up their Gram matrix inside the tasks. The Cholesky factor of that matrix, shifted where it would
break down, is the next factor; passes go on until the rows are orthonormal. The factors' product R
has the singular values and right vectors of the centred list, without the squared condition number
of a covariance matrix. The driver holds matrices of the vectors' dimension only.

Cases: rows whose vector is null, empty or holds null or non-finite entries are left out, and so are
vectors of another length than the commonest among distinct ones (the longer on a tie); entries
beyond 64 bits stop at their range. Rows without an id, with a repeated id or equal to others stay,
one result each. A component without variance has a null ``whitened``; ``deviation`` is null where it
does not fit a long; an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxstars.sources.staging import stage

CELLS = 1 << 20  # entries that a task works on at a time
UNIT = 2.0**-53
PASSES = 12
NO_VARIANCE = 1e-12  # of the largest singular value
MOST = 1 << 62


def whole_vectors(table, vec_id="vec_id", vector="embedding", scale=256):
    """Id and whole-number vector of every row that takes part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrices(column, d):
    """The vectors of a batch as matrices of a bounded number of entries."""
    rows = max(1, CELLS // d)
    for a in range(0, len(column), rows):
        part = column.slice(a, rows)
        yield np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(part), d)


def _sums(d):
    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for x in _matrices(batch.column(0), d):
                safe = int(np.abs(x).max(initial=0)) * len(x) < MOST and int(x.min(initial=0)) > -MOST
                total = total + (x if safe else x.astype(object)).sum(axis=0).astype(object)
                n += len(x)
        if n:
            sums = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": sums})

    return run


def _centred(x, low, part):
    """x less the mean, whose whole part is ``low`` and whose rest is ``part``."""
    if x.max(initial=0) >= MOST or x.min(initial=0) <= -MOST:
        return x.astype(np.float64) - low.astype(np.float64) - part
    return (x - low).astype(np.float64) - part


def _solved(a, r):
    """q with q r = a, r upper triangular: one column after the other."""
    q = np.empty_like(a, order="F")
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(d, low, part, kept, steps):
    def run(batches):
        total = np.zeros((len(kept), len(kept)))
        for batch in batches:
            for x in _matrices(batch.column(0), d):
                a = np.asfortranarray(_centred(x[:, kept], low[kept], part[kept]))
                for r in steps:
                    a = _solved(a, r)
                total += a.T @ a
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(kept)), pa.int32()), "g": pa.array([row.tobytes() for row in total], pa.binary())})

    return run


def _added(table):
    rows = np.array([np.frombuffer(g, np.float64) for g in sorted(table.column("g").to_pylist())])
    return pa.table({"i": table.column("i").slice(0, 1), "g": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})


def gram(fit, d, low, part, kept, steps):
    """Gram matrix of the centred rows behind the given factors: a row of it is added up in one task."""
    parts = fit.mapInArrow(_gram(d, low, part, kept, steps), "i int, g binary")
    found = parts.groupBy("i").applyInArrow(_added, "i int, g binary").collect()
    return np.array([np.frombuffer(r["g"], np.float64) for r in sorted(found, key=lambda r: r["i"])])


def _upper(g, shift):
    """Upper Cholesky factor of g, shifted by ``shift`` times its norm, more where that is not enough."""
    norm = float(np.linalg.eigvalsh(g)[-1])
    while True:
        try:
            return np.linalg.cholesky(g + shift * norm * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift, UNIT) * 100


def shifted_cholesky_qr(rows_gram, n, d):
    """R of the centred rows, and the trace of their Gram matrix. ``rows_gram(steps)`` is one pass.

    A direction is settled when its length is one, or when rounding alone is left of it.
    """
    shift = 11 * (min(n, CELLS) * d + d * (d + 1)) * UNIT
    steps, whole, trace = [], np.eye(d), None
    for _ in range(PASSES):
        g = rows_gram(steps)
        trace = float(np.trace(g)) if trace is None else trace
        lengths = np.linalg.eigvalsh(g)
        orthonormal = bool(steps) and bool(np.all((np.abs(lengths - 1) < 1e-10) | (lengths < 1e-8)))
        plain = bool(steps) and lengths[0] > 0.1
        r = _upper(g, 0.0 if plain else shift)
        steps.append(r)
        whole = r @ whole
        if orthonormal:
            break
    return whole, trace


class Fit:
    """What the passes found: mean, components in columns, eigenvalues, and how far from whitened it is."""


def fit_whitening(fit, d, k):
    sums = fit.mapInArrow(_sums(d), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = sorted(sums.collect(), key=lambda r: r["i"])
    out = Fit()
    out.n, out.sums = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    out.low = np.array([s // out.n for s in out.sums], np.int64)
    out.part = np.array([(s % out.n) / out.n for s in out.sums])
    first = gram(fit, d, out.low, out.part, np.arange(d), [])
    kept = np.flatnonzero(np.diag(first) > 0)  # a constant entry has no part in any component
    k = min(k, d)
    out.whiten, out.explained, out.error = np.full((d, k), np.nan), [None] * k, None
    if not len(kept):
        return out
    grams = lambda steps: gram(fit, d, out.low, out.part, kept, steps) if steps else first[np.ix_(kept, kept)]
    r, trace = shifted_cholesky_qr(grams, out.n, len(kept))
    _, values, vectors = np.linalg.svd(r)
    for j in range(k):
        value = values[j] if j < len(kept) else 0.0
        out.explained[j] = float(value**2 / trace)
        if value > NO_VARIANCE * values[0]:
            out.whiten[:, j] = 0
            out.whiten[kept, j] = vectors[j] * (np.sqrt(out.n) / value)
    fine = np.flatnonzero(~np.isnan(out.whiten[0]))
    out.error = float(fit.mapInArrow(_moments(d, out, fine), "m binary").groupBy().applyInArrow(_identity_error(out.n, len(fine)), "e double").first()[0])
    return out


def _moments(d, found, fine):
    """Sums and products of a task's whitened rows."""
    low, part, whiten = found.low, found.part, found.whiten[:, fine]

    def run(batches):
        total = np.zeros((len(fine) + 1, len(fine) + 1))
        for batch in batches:
            for x in _matrices(batch.column(0), d):
                z = np.c_[_centred(x, low, part) @ whiten, np.ones(len(x))]
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    return run


def _identity_error(n, k):
    def run(table):
        total = sum(np.frombuffer(m, np.float64).reshape(k + 1, k + 1) for m in table.column("m").to_pylist())
        mean = total[:k, k] / n
        return pa.table({"e": [float(np.abs(total[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())]})

    return run


def _deviation(x, n, sums):
    """Sum over the entries of (n x - S)^2 as exact whole numbers."""
    m, most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, sums))
    own = x if m * m * len(sums) < MOST else x.astype(object)
    squares = (own * own).sum(axis=1).astype(object)
    small = most < MOST and m * most * len(sums) < MOST
    products = (x @ np.array(sums, np.int64) if small else x.astype(object) @ np.array(sums, object)).astype(object)
    return n * n * squares - 2 * n * products + sum(s * s for s in sums)


def _whitened(d, k, found, id_type):
    n, sums, low, part, whiten, explained, error = found.n, found.sums, found.low, found.part, found.whiten, found.explained, found.error

    def run(batches):
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(1), d):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                z = _centred(x, low, part) @ whiten
                far = [v if v < 1 << 63 else None for v in _deviation(x, n, sums).tolist()]
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(rows)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(rows), n, np.int64)),
                    "deviation": pa.array(far, pa.int64()).take(pa.array(rows)),
                    "whitened": pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                    "explained": pa.array(explained * len(x), pa.float64()),
                    "identity_error": pa.array([error] * len(rows), pa.float64()),
                })

    return run


def whiten(table, k=4, vec_id="vec_id", vector="embedding", scale=256):
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) up to component k.

    ``whitened`` is the centred vector's projection on the component, divided by its deviation.
    """
    rows = whole_vectors(table, vec_id, vector, scale)
    out = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType)])
    for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        out.add(name, kind)
    fit = stage(rows.select("x").distinct())
    commonest = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None:
        return table.sparkSession.createDataFrame([], out)
    d = commonest["d"]
    found = fit_whitening(fit.filter(F.size("x") == d), d, k)
    return rows.filter(F.size("x") == d).mapInArrow(_whitened(d, min(k, d), found, None), out)
