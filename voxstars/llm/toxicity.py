"""Toxic passages: maximum-scoring segments over token log-odds.

Training compares the words, and the beginnings of words, of documents labelled toxic with those of
the others. Each one's log-odds ratio is smoothed by a Dirichlet prior in proportion to its share of
all labelled text; those whose ratio is large against its standard error are kept. A token scores
the ratio of its longest known part, else zero, less a small constant. One scan finds every
maximal-scoring segment of a text. A segment of score S in n tokens is calibrated by extreme-value
statistics: E = K n exp(-lambda S) segments as good are expected in clean text, where lambda solves
sum p exp(lambda s) = 1 over the clean token distribution and K fits clean documents. Segments are
those of all tokens, so a passage is found wherever and however often it stands. For the document's
score each word counts once, in the best segment that has it: the significances -ln E of the
segments of what is then left are added, and a logistic curve of the sum's logarithm, fitted on a
fold that gave no log-odds, gives the score.

Bounds: about ``max_labelled`` labelled rows, whose ids are broadcast. The table of log-odds has every
token that passes the test, 16 bytes each, and travels with the tasks. It follows that sample alone:
to pass with ``SURE`` = 3.5 a token needs about ten labelled documents or more, so there are at most a
tenth as many as the sample has words and beginnings. Every document is scored whole.

Cases: null and empty texts have no segment and get the curve's lowest score; without labels of both
classes all scores are the share of toxic labels (0.5 without any); repeated rows are scored alike.
Other columns are not looked at, whatever their names. A text is scanned whole, in slices of 1 MB; a longer
text is one slice.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxstars.llm.resampling import labelled
from voxstars.llm.texts import LETTER, LOWER, PRIME, mixed, rows_of, runs, slices, text_bytes, token_hashes
from voxstars.sources.staging import stage

MAX_LABELLED = 500_000
PRIOR = 0.05
SURE = 3.5
DRIFT = 0.1
GRID, STEP = 8192, 0.01
BEGINNINGS = (4, 5, 6, 7, 8)
MAYBE = (1 << 20) - 1
EULER = 0.5772156649015329
SEGMENTS = "array<struct<start:bigint,end:bigint,gain:double>>"


def _tokens(data, offsets):
    """Starts, ends, and per token the hashes of its beginnings, shortest first, and of the whole word.

    A beginning that the word is too short for is 0.
    """
    starts, ends = runs(LETTER[data], offsets)
    keys = np.zeros((len(BEGINNINGS) + 1, len(starts)), np.int64)
    for row, n in zip(keys, BEGINNINGS):
        long = ends - starts >= n
        row[long] = token_hashes(data, starts[long], starts[long] + n).view(np.int64)
    keys[-1] = (token_hashes(data, starts, ends) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
    return starts, ends, keys


def _counted(batches):
    """Clean and toxic documents of one task that hold each word or beginning."""
    keys, clean, toxic = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        label = batch.column(1).to_numpy()
        for a, part, at in slices(data, offsets):
            starts, _, hashes = _tokens(LOWER[part], at)
            rows = np.tile(rows_of(at, starts), len(hashes))
            hashes = hashes.ravel()
            once = np.unique(mixed(hashes.view(np.uint64) + rows.astype(np.uint64) * PRIME), return_index=True)[1]
            hashes, bad = hashes[once], label[a:][rows[once]]
            all_keys, at_key = np.unique(np.r_[keys, hashes], return_inverse=True)
            new = np.r_[np.zeros(len(keys)), bad], np.r_[np.zeros(len(keys)), 1 - bad]
            new[0][: len(keys)], new[1][: len(keys)] = toxic, clean
            toxic = np.bincount(at_key, weights=new[0], minlength=len(all_keys)).astype(np.int64)
            clean = np.bincount(at_key, weights=new[1], minlength=len(all_keys)).astype(np.int64)
            keys = all_keys
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(clean), pa.array(toxic)], names=["token", "clean", "toxic"])


def log_odds(docs, prior=PRIOR, sure=SURE):
    """Tokens with a sure log-odds ratio: token hash and score.

    ``docs`` has text and label; a document counts once for each token. The Dirichlet prior is the
    labelled text as a whole: a token's pseudo-count is its count in both classes times ``prior``. A
    token kept as toxic must make a document that holds it more likely toxic than not.
    """
    counts = stage(
        docs.select("text", "label")
        .mapInArrow(_counted, "token long, clean long, toxic long")
        .filter("token <> 0")
        .groupBy("token")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    n_clean, n_toxic = (float(x or 0) for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    if not n_clean or not n_toxic:
        return None
    weight = prior * (n_clean + n_toxic)
    a = (F.col("clean") + F.col("toxic")) * F.lit(prior)
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(n + weight) - F.col(y) - a))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    rows = counts.withColumn("score", odds("toxic", n_toxic) - odds("clean", n_clean)).withColumn("z", F.col("score") / error)
    base = docs.agg(F.avg("label")).first()[0]
    rows = rows.filter((F.abs("z") >= sure) & ((F.col("score") < 0) | (F.col("score") > float(np.log(1 / base - 1)))))
    return rows.select("token", "score").toPandas()


def token_scores(hashes, rows, table):
    """The score of each token: the log-odds of its longest known part, or none, less the drift."""
    keys, values, maybe = table
    scores = np.zeros(hashes.shape[1])
    for row in hashes:
        hit = np.flatnonzero(maybe[row & MAYBE])
        at = np.minimum(np.searchsorted(keys, row[hit]), max(0, len(keys) - 1))
        known = keys[at] == row[hit] if len(keys) else np.zeros(0, bool)
        scores[hit[known]] = values[at[known]]
    return scores - DRIFT


def fresh_scores(scores, words, rows, gains):
    """The scores with each positive word of a text counted once, so that one word is no evidence of its own.

    It counts in the segment of the largest gain that has it (``gains``, of each token's segment), at its
    first place there; elsewhere only the drift does.
    """
    good = np.flatnonzero(scores > 0)
    keys = mixed(words[good].view(np.uint64) + rows[good].astype(np.uint64) * PRIME)
    order = np.lexsort((good, -gains[good], keys))
    again = np.r_[False, keys[order][1:] == keys[order][:-1]][: len(good)]
    out = scores.copy()
    out[good[order[again]]] = -DRIFT
    return out


def lookup_table(tokens, values):
    """Sorted tokens, their values, and a bit table that tells most unknown tokens apart at once."""
    order = np.argsort(tokens)
    maybe = np.zeros(MAYBE + 1, bool)
    maybe[tokens & MAYBE] = True
    return tokens[order], values[order], maybe


def maximal_segments(scores):
    """Every maximal-scoring segment (Ruzzo and Tompa): [start, end, score] lists in order.

    Only positive scores can begin or end a segment, so the loop runs over these; each new piece is
    merged with earlier ones for as long as that makes a better segment. Links to the segments that
    begin lower keep the scan linear.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    held = []  # start, end, sum before, sum after, last earlier segment that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                break
            start, _, left, _, lower = held[j]
            del held[j:]
            j = lower
        held.append((start, end, left, right, j))
    return [(s, e, r - lo) for s, e, lo, r, _ in held]


def solve_lambda(scores, shares):
    """The positive root of sum p exp(lambda s) = 1; the mean score must be negative."""
    excess = lambda x: float((shares * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2


def score_shares(clean, table):
    """Distinct token scores of clean text and their shares, over a fixed grid of scores."""

    def run(batches):
        n = np.zeros(GRID, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for _, part, at in slices(data, offsets):
                starts, _, hashes = _tokens(LOWER[part], at)
                scores = token_scores(hashes, rows_of(at, starts), table)
                n += np.bincount(np.clip(np.rint(scores / STEP) + GRID // 2, 0, GRID - 1).astype(np.int64), minlength=GRID)
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells])], names=["cell", "n"])

    cells = clean.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = cells["n"].to_numpy(float)
    return (cells["cell"].to_numpy() - GRID // 2) * STEP, n / n.sum()


def _scanned(table):
    """Token count and segments of every row (an id and a text), and the gains with each word counted once."""
    segment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64())]))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            counts, spans, fresh = [], [], []
            for _, part, at in slices(data, offsets):
                starts, ends, hashes = _tokens(LOWER[part], at)
                rows = rows_of(at, starts)
                scores = token_scores(hashes, rows, table)
                bounds = np.searchsorted(starts, at)
                hot = np.r_[0, np.cumsum(scores > 0)]
                counts.append(np.diff(bounds))
                texts, gains = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), at[:-1].tolist())), np.zeros(len(scores))
                for lo, hi, base in texts:
                    found = maximal_segments(scores[lo:hi]) if hot[hi] > hot[lo] else ()
                    for a, b, gain in found:
                        gains[lo + a : lo + b] = gain
                    spans.append([
                        {"start": int(starts[lo + a]) - base, "end": int(ends[lo + b - 1]) - base, "gain": gain}
                        for a, b, gain in found
                    ])
                once = fresh_scores(scores, hashes[-1], rows, gains)
                fresh += [[gain for _, _, gain in maximal_segments(once[lo:hi])] if hot[hi] > hot[lo] else [] for lo, hi, _ in texts]
            n = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            columns = [batch.column(0), n, pa.array(spans, segment), pa.array(fresh, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "segments", "fresh"])

    return run


def significance(lam, log_k):
    """ln(1 + sum of -ln E over the segments of a text, each word counted once, with E below 1)."""
    log_e = lambda gain: F.lit(log_k) + F.log(F.col("n_tokens").cast("double")) - F.lit(lam) * gain
    total = F.aggregate("fresh", F.lit(0.0), lambda total, gain: total + F.greatest(F.lit(0.0), -log_e(gain)))
    return F.log1p(total)


def fit_curve(cells, steps=50):
    """Intercept and slope of a logistic curve from (value, label, count) rows, by Newton steps."""
    x, y, n = (cells[c].to_numpy(float) for c in ("value", "_label", "n"))
    w, design = np.zeros(2), np.c_[np.ones(len(x)), x]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * w
        w = w + np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), np.clip(gradient, -1e6, 1e6))
        w = np.clip(w, -30, 30)
    return float(w[0]), max(0.0, float(w[1]))


def score(docs, labels, label="toxic", max_labelled=MAX_LABELLED):
    """doc_id, score in [0, 1], significant segments (byte spans) of every row of ``docs``.

    ``labels`` holds the rows that may be learnt from; nothing else of them reaches a score.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    given = stage(labelled(labels, label, max_labelled))
    fold = F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(4))
    first, second = F.broadcast(given.filter(fold > 0)), F.broadcast(given.filter(fold == 0))
    marked = docs.join(first, docs["doc_id"] == first["_id"]).select("text", F.col("_label").alias("label"))
    odds = log_odds(marked)
    if odds is None:
        share = given.agg(F.coalesce(F.avg("_label"), F.lit(0.5))).first()[0]
        return docs.select("doc_id", F.lit(share).alias("score"), F.expr("array()").cast(SEGMENTS).alias("segments"))
    rows = odds
    table = lookup_table(rows["token"].to_numpy(), rows["score"].to_numpy())
    scanned = stage(docs.mapInArrow(_scanned(table), f"doc_id long, n_tokens long, segments {SEGMENTS}, fresh array<double>"))
    clean = docs.join(first.filter("_label = 0"), docs["doc_id"] == F.col("_id")).select("text")
    lam = solve_lambda(*score_shares(clean, table))
    known = scanned.join(second, scanned["doc_id"] == second["_id"])
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["gain"])), F.lit(0.0))
    centre = known.filter("_label = 0 AND n_tokens > 0").agg(F.avg(best * lam - F.log("n_tokens"))).first()[0]
    log_k = float(centre or 0.0) - EULER
    value = significance(lam, log_k)
    cells = known.groupBy(F.round(value, 2).alias("value"), "_label").agg(F.count(F.lit(1)).alias("n"))
    intercept, slope = fit_curve(cells.toPandas())
    curve = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * value)))
    sure = F.filter("segments", lambda s: F.lit(lam) * s["gain"] > log_k + F.log(F.col("n_tokens").cast("double")))
    return scanned.select("doc_id", curve.alias("score"), sure.alias("segments"))
