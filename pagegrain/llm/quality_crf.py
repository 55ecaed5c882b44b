"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's score comes from counts of its own characters and words and
from those of its neighbours, transitions tie adjacent lines.  Forward-backward marginals, weighted
by line length, give a document's bad share; a one-dimensional logistic curve fitted on the
training documents turns it into a score from 0 to 1 (higher: better).

Only documents are labelled.  Lines of good documents are good; in bad ones the worst line and
all that a first line model (later the field itself) finds bad are bad, which is repeated ``ROUNDS`` times.

Fitting uses at most ``FIT_ROWS`` labelled documents, those with the smallest hash of their id, and of these as many as
have at most ``FIT_LINES`` lines in all, without such as have over ``FIT_LINES_EACH``; only their
line features reach the driver.  Scoring is row by row and reads whole texts.

Edge cases: null and empty texts have one empty line, no bad share and thus the score of a text
without bad lines.  Null labels and ids are not learned from; several labels of an id count as their
smallest.  With labels of one kind only, or none, every document gets the share of good labels (1 if
none).  Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rows, textscan, workspace

FIT_ROWS = 6000
FIT_LINES = 400_000
FIT_LINES_EACH = 2000
#: Texts of more lines are scored one by one, by plain numbers: a step for all texts of a block would be for few of them.
LONG_CHAIN = 512
ROUNDS = 2
STEPS = 120
THRESHOLD = 0.3
FIELDS = [T.StructField("bad_share", T.DoubleType()), T.StructField("score", T.DoubleType())]


def _class_table(*groups: str) -> np.ndarray:
    t = np.zeros(256, np.uint64)
    for i, g in enumerate(groups):
        for c in g.encode("latin-1"):
            t[c] += np.uint64(1) << np.uint64(32 * i)
    return t


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = (_class_table("#*$%&<>~^@=+_\\", "|"), _class_table("!?", _UPPER), _class_table("0123456789", ".,;:"), _class_table(_UPPER.lower(), " \t\r\x0b\x0c"))


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each \\n-split line, its length in bytes, first line of each text and the end)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, offsets[:-1], "left") + np.arange(len(offsets) - 1)
    first = np.append(first, len(start))
    end = np.append(start[1:], n)
    closing = np.zeros(len(start), bool)
    closing[first[1:] - 1] = True
    end = np.where(closing, end, end - 1)
    size = (end - start).astype(np.float64)
    counts = []
    for table in _COUNTS:
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data], out=run[1:])
        got = run[end] - run[start]
        counts += [(got & np.uint64(0xFFFFFFFF)).astype(np.float64), (got >> np.uint64(32)).astype(np.float64)]
    w = textscan.Words(data, offsets, textscan.NON_SPACE)
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    words = (hi - lo).astype(np.float64)
    again = np.zeros(len(w.start) + 1, np.int64)
    again[2:] = np.cumsum(w.hash[1:] == w.hash[:-1]) if len(w.start) else 0
    repeats = np.where(hi > lo, again[hi] - again[np.minimum(lo + 1, hi)], 0).astype(np.float64)
    symbols, pipes, bangs, upper, digits, stops, lower, blanks = counts
    one, per = np.maximum(words, 1), np.maximum(size, 1)
    own = np.stack([
        np.minimum(symbols / one, 3), np.minimum(pipes / one, 1), np.minimum(bangs / one, 3), upper / np.maximum(upper + lower, 1),
        repeats / one, digits / per, np.minimum(stops / one, 2), np.minimum((size - blanks) / one, 30) / 10, np.log1p(words) / 5, (words == 0) * 1.0,
    ], axis=1)
    return own, size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 beyond the text), and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


class Chains:
    """Chains of lines, longest first, for passes that take one step in all chains at a time."""

    def __init__(self, first: np.ndarray):
        self.first = first
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = first[:-1][order], size[order]
        self.active = np.searchsorted(-self.size, -np.arange(1, (self.size[0] if len(size) else 0) + 1), "right")

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(bad) of each line, expected 2 x 2 transitions, log partition.  unary: score of bad over good; pair: transition scores."""
        n = len(unary)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        u = np.stack([np.zeros(n), unary], axis=1)
        a[self.begin] = u[self.begin]
        for t in range(1, len(self.active)):
            i = self.begin[:self.active[t]] + t
            a[i] = u[i] + np.logaddexp(a[i - 1, 0][:, None] + pair[0], a[i - 1, 1][:, None] + pair[1])
        for t in range(len(self.active) - 1, 0, -1):
            i = self.begin[:self.active[t]] + t
            z = u[i] + b[i]
            b[i - 1] = np.logaddexp(pair[:, 0] + z[:, :1], pair[:, 1] + z[:, 1:])
        ends = self.begin + self.size - 1
        total = np.zeros(n)
        last = np.logaddexp(a[ends, 0], a[ends, 1])
        total[self.first[:-1]] = 1
        chain = np.cumsum(total).astype(np.int64) - 1
        z = np.empty(len(self.begin))
        z[chain[self.begin]] = last
        log_z = z[chain]
        p = np.exp(a + b - log_z[:, None])
        inner = np.flatnonzero(total == 0)
        both = a[inner - 1][:, :, None] + pair + (u[inner] + b[inner])[:, None, :] - log_z[inner][:, None, None]
        return p[:, 1], np.exp(both).sum(axis=0), float(last.sum())


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def long_marginals(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(bad) of each line of one text, from the log odds of the two states before and behind each line."""
    (gg, gb), (bg, bb) = pair.tolist()
    u = unary.tolist()
    before, behind = [u[0]], [0.0]
    for x in u[1:]:
        f = before[-1]
        before.append(x + _log_sum(gb, bb + f) - _log_sum(gg, bg + f))
    for x in u[:0:-1]:
        f = x + behind[-1]
        behind.append(_log_sum(bg, bb + f) - _log_sum(gg, gb + f))
    return _sigmoid(np.array(before) + np.array(behind[::-1]))


def line_marginals(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(bad) of each line of all texts."""
    size = np.diff(first)
    long = size > LONG_CHAIN
    if not long.any():
        return Chains(first).marginals(unary, pair)[0]
    out, short = np.empty(len(unary)), np.repeat(~long, size)
    if short.any():
        out[short] = Chains(np.concatenate([[0], np.cumsum(size[~long])])).marginals(unary[short], pair)[0]
    for d in np.flatnonzero(long).tolist():
        out[first[d]:first[d + 1]] = long_marginals(unary[first[d]:first[d + 1]], pair)
    return out


def _adam(x: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Model:
    """Weights of line features, transition scores, and the curve from bad share to score."""

    def __init__(self, weights: np.ndarray | None, pair: np.ndarray | None, curve: tuple[float, float]):
        self.weights, self.pair, self.curve = weights, pair, curve

    def shares(self, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted bad share of each text."""
        if self.weights is None or not len(own):
            return np.zeros(len(first) - 1)
        bad = line_marginals(with_neighbours(own, first) @ self.weights, self.pair, first)
        total = np.add.reduceat(size, first[:-1])
        return np.add.reduceat(size * bad, first[:-1]) / np.maximum(total, 1)

    def score(self, share: np.ndarray) -> np.ndarray:
        """The curve is over the root of the share, which tells small shares from none."""
        return _sigmoid(self.curve[0] - self.curve[1] * np.sqrt(share))


def fit(own: np.ndarray, size: np.ndarray, first: np.ndarray, good: np.ndarray, *, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """own, size, first: of the lines of all labelled texts; good: label of each text."""
    if not len(good) or good.all() or not good.any():
        rate = float(good.mean()) if len(good) else 1.0
        return Model(None, None, (float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))), 0.0))
    x, chains = with_neighbours(own, first), Chains(first)
    bad_text = np.repeat(1.0 - good, np.diff(first))
    n, texts = len(x), len(good)

    def lines_of(p: np.ndarray) -> np.ndarray:
        """Bad lines, given P(bad): in each bad text the worst, and all above one half."""
        worst = np.repeat(np.maximum.reduceat(p, first[:-1]), np.diff(first))
        return bad_text * ((p >= 0.5) | (p >= worst))

    balance = np.where(bad_text > 0, 0.5 / max(bad_text.sum(), 1), 0.5 / max(n - bad_text.sum(), 1))
    w = _adam(np.zeros(x.shape[1]), lambda w: x.T @ (balance * (_sigmoid(x @ w) - bad_text)) + 1e-4 * w, steps, 0.1)
    y = lines_of(_sigmoid(x @ w))
    params = np.concatenate([w, np.zeros(4)])
    head = np.zeros(n, bool)
    head[first[:-1]] = True
    inner = np.flatnonzero(~head)
    for _ in range(rounds):
        seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(np.int64), minlength=4).astype(float)

        def gradient(p: np.ndarray, y=y, seen=seen) -> np.ndarray:
            bad, moves, _ = chains.marginals(x @ p[:-4], p[-4:].reshape(2, 2))
            return np.concatenate([x.T @ (bad - y), moves.ravel() - seen]) / texts + 1e-3 * p

        params = _adam(params, gradient, steps, 0.05)
        bad, _, _ = chains.marginals(x @ params[:-4], params[-4:].reshape(2, 2))
        y = lines_of(bad)
    model = Model(params[:-4], params[-4:].reshape(2, 2), (0.0, 0.0))
    share = model.shares(own, size, first)
    z = np.stack([np.ones(texts), -np.sqrt(share)], axis=1)
    curve = _adam(np.array([2.0, 10.0]), lambda c: z.T @ (_sigmoid(z @ c) - good) / texts + 1e-4 * c * np.array([0, 1]), 400, 0.1)
    return Model(model.weights, model.pair, (float(curve[0]), float(curve[1])))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_lines: int = FIT_LINES, fit_lines_each: int = FIT_LINES_EACH) -> Model:
    """A model from at most ``fit_rows`` labelled documents that are not held out, with at most ``fit_lines`` lines."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label is not null")
    known = known.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(known), "id").select(F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            raw, offs = textscan.string_buffers(x.column(2))
            for a, b in textscan.blocks(offs):
                own, size, first = line_table(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                count = np.diff(first)
                cells = [np.concatenate([own[i:j], size[i:j, None]], axis=1).astype("<f4").tobytes() if j - i <= fit_lines_each else b"" for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0).slice(a, b - a), x.column(1).slice(a, b - a), pa.array(count, pa.int64()), pa.array(cells, pa.binary())], names=["id", "label", "n", "lines"])

    table = workspace.written(workspace.in_arrow(chosen, features, "id string, label int, n long, lines binary").where(F.col("n") <= fit_lines_each), "crf-lines")
    found = sorted((r["id"], r["label"], bytes(r["lines"])) for r in _within(table, fit_lines).collect())
    tables = [np.frombuffer(x[2], "<f4").astype(np.float64) for x in found]
    width = 11
    tables = [t.reshape(-1, width) for t in tables]
    lines = np.concatenate(tables) if tables else np.zeros((0, width))
    first = np.concatenate([[0], np.cumsum([len(t) for t in tables], dtype=np.int64)])
    return fit(lines[:, :-1], lines[:, -1], first, np.array([float(x[1] == 1) for x in found]))


def _within(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with at most ``limit`` lines in all: those under a hash of the id, found from sums by 1,024 parts of its range."""
    part = F.pmod(F.xxhash64("id"), F.lit(1024))
    sums = dict(map(tuple, rows.groupBy(part.alias("part")).agg(F.sum("n")).collect()))
    upto, total = 0, 0
    while upto < 1024 and total + sums.get(upto, 0) <= limit:
        total += sums.get(upto, 0)
        upto += 1
    return rows if upto == 1024 else rows.where(part < upto)


def classify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with bad_share and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        raw, offs = textscan.string_buffers(column)
        share = [held.value.shares(*line_table(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])) for a, b in textscan.blocks(offs)]
        share = np.concatenate(share) if share else np.zeros(0)
        return [pa.array(share), pa.array(held.value.score(share))]

    return rows.extend(docs, text, FIELDS, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: scores of all documents; a fifth of the labels is held out."""
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, workspace.table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
