"""Benchmark passages in documents, found by pigeonhole edit matching.

An item may be changed by a share of its characters: its error budget e. It is split into e + 1 pieces,
of which at least one must occur unchanged. One automaton of all pieces finds exact hits in whole
texts; hits on the same diagonal, up to e, are one candidate, which shared strings of four characters
can refuse (each edit takes four away at most) and Myers' bit-parallel distance decides. Texts and
items are compared in code points after Unicode case folding, with white space as one blank; pieces,
budgets, distances and places all count those.

Items are sent to the tasks in blocks of at most ``block_bytes``; documents are read once a block.

Cases: null and empty texts or items match nothing; items under ``1 / error_rate`` characters have no
budget and match exactly, and only as whole words ("no" is not in "another"); repeated items, and items with a null id, are matched like others; every
row of ``docs`` is searched on its own.
Other columns are not looked at, whatever their names. A text is searched whole; a task holds one text's
normal form, about four bytes a character, beside the automaton.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

ERROR_RATE = 0.08
FOUND = "doc_id long, item_id long, start long, end long, distance int"


def normal(data):
    """The case-folded text of UTF-8 bytes with one blank between words."""
    return " ".join(data.decode("utf-8", "replace").casefold().split())


def cut(text, parts):
    """(offset, piece) of ``parts`` pieces whose lengths differ by one at most."""
    edges = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern_bits, length, text, most):
    """(distance, end) of the best match of a pattern within a text, or None beyond ``most``.

    One bit a pattern character: vertical differences up and down, as Myers gave them; the text may
    start and end anywhere.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, at = most + 1, 0
    for i, c in enumerate(text):
        same = pattern_bits.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if score < best:
            best, at = score, i + 1
    return (best, at) if best <= most else None


def within_word(text, start, end):
    """Whether one of the borders of a part of a text lies inside a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return inside(start) or inside(end)


class Matcher:
    """The pieces of a block of items, built once a task."""

    def __init__(self, items, error_rate=ERROR_RATE):
        self.items, self.automaton = [], ahocorasick.Automaton()
        held = {}
        for item_id, text in items:
            text = normal(text.encode())
            if not text:
                continue
            budget = int(len(text) * error_rate)
            bits = {}
            for i, c in enumerate(text):
                bits[c] = bits.get(c, 0) | (1 << i)
            grams = {text[i : i + 4] for i in range(len(text) - 3)}
            for offset, piece in cut(text, budget + 1):
                held.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, bits, grams))
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        if held:
            self.automaton.make_automaton()

    def find(self, data):
        """(item id, start, end, distance) of every match in a text's normal form."""
        if not self.items:
            return []
        text, hits = normal(data), {}
        for last, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                hits.setdefault(item, set()).add(last - length + 1 - offset)
        found = []
        for item, starts in hits.items():
            item_id, wanted, budget, bits, grams = self.items[item]
            covered = None
            for start in sorted(starts):
                if covered is not None and start <= covered:
                    continue
                if not budget and within_word(text, start, start + len(wanted)):
                    continue
                if start >= 0 and text.startswith(wanted, start):
                    found.append((item_id, start, start + len(wanted), 0))
                    covered = start + budget
                    continue
                # Later starts within the budget of this one fall into the same window.
                a, b = max(0, start - budget), start + len(wanted) + 2 * budget
                window = text[a:b]
                if len(grams) > 4 * budget:
                    shared = len(grams.intersection([window[i : i + 4] for i in range(len(window) - 3)]))
                    if shared < len(grams) - 4 * budget:
                        covered = start + budget
                        continue
                match = myers(bits, len(wanted), window, budget)
                covered = start + budget
                if match:
                    found.append((item_id, max(0, a + match[1] - len(wanted)), a + match[1], match[0]))
        return found


def item_blocks(benchmark, block_bytes=4 << 20):
    """Lists of (item_id, text) of bounded size, one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes // 2)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.filter(part == i).collect()]


def _searched(items, error_rate):
    def run(batches):
        matcher = Matcher(items, error_rate)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1)):
                if text.is_valid:
                    rows.extend((doc_id, *match) for match in matcher.find(text.as_buffer().to_pybytes()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 4 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc_id", "item_id", "start", "end", "distance"],
            )

    return run


def matches(docs, benchmark, error_rate=ERROR_RATE):
    """Every passage: doc_id, item_id, where in the normal form, and its edit distance."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in item_blocks(benchmark):
        found = rows.mapInArrow(_searched(items, error_rate), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(items, error_rate=ERROR_RATE):
    """A column function: whether a text holds a passage of one of the items."""
    held = []

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(items, error_rate))
        return pa.array([t.is_valid and bool(held[0].find(t.as_buffer().to_pybytes())) for t in texts], pa.bool_())

    return holds


def clean(docs, benchmark, error_rate=ERROR_RATE):
    """The rows of ``docs`` without a benchmark passage."""
    for items in item_blocks(benchmark):
        docs = docs.filter(~contaminated(items, error_rate)(F.col("text")))
    return docs
