"""Document quality by a linear-chain conditional random field over lines.

Method: every line is good or bad; a line's features are its own and those of its neighbours; the chain has a
weight for each pair of consecutive states. Forward-backward gives each line's marginal probability of being
good, and a document's score is their mean weighted by the lines' lengths. The weights maximise the penalised
likelihood of a bounded sample of labelled documents, whose lines bear the document's label.

The sample is the only bound: SAMPLE labelled documents, those with the smallest hashes of their ids, and of these as many,
in that order, as have LINES lines together, whose features (FEATURES bytes a line) go to the driver. Scoring reads whole
texts of all rows. Labels, languages, sources and ids are not inputs of a score.

Defined results: null, empty and blank texts are one empty line; without labelled rows every weight is 0 and
every score 0.5; null labels are ignored; repeated rows count as often; extra columns are ignored.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import cut

SAMPLE, LINES, STEPS, RATE, PENALTY = 4000, 200_000, 150, 0.2, 1.0
SYMBOLS = "#$%&*@^~_=<>\\/{}[]+"
#: Names of a line's own features; flags come again for the lines before and after.
OWN = ("bias", "empty", "short", "long", "open_end", "shared_words", "seldom_new", "all_same")
FLAGS = ("symbols", "many_symbols", "bars", "many_bars", "shouts", "capitals", "doubled", "much_doubled", "digits", "again", "long_words")
FEATURES = (*OWN, *FLAGS, *(f"{side}_{name}" for side in ("before", "after") for name in FLAGS), "first", "last")


def flags_of(line: str, words: list[str], seen: bool) -> list[float]:
    n, size = max(len(words), 1), max(len(line), 1)
    symbols = sum(map(line.count, SYMBOLS)) / size
    bars = line.count("|") / size
    doubled = sum(map(eq, words, words[1:])) / n
    digits = sum(map(line.count, "0123456789")) / size
    capitals = sum(map(str.isupper, words)) / n
    return [float(x) for x in (symbols > 0.02, symbols > 0.1, bars > 0.01, bars > 0.05, line.count("!!") / n > 0.1, capitals > 0.4, doubled > 0.05, doubled > 0.3, digits > 0.3, seen, size / n > 14)]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines of a text that aren't blank; of one empty line, if there are none."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    own, flags, seen = [], [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        new = len(set(words)) / max(n, 1)
        own.append([1.0, float(n == 0), float(n <= 3), float(n > 150), float(not line.rstrip().endswith((".", "!", "?", ":"))), float(n >= 8 and new < 0.7), float(n >= 8 and new < 0.4), float(n >= 4 and new < 0.15)])
        flags.append(flags_of(line, words, line in seen and n > 3))
        seen.add(line)
    own, flags = np.array(own), np.array(flags)
    none = np.zeros((1, flags.shape[1]))
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1.0
    return np.hstack([own, flags, np.vstack([none, flags[:-1]]), np.vstack([flags[1:], none]), ends]), np.array([max(len(x), 1) for x in lines], float)


def forward_backward(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals (lines, 2) of a chain with log potentials emit (lines, 2) and step (2, 2)."""
    e = np.exp(emit - emit.max(1, keepdims=True)).tolist()
    (a, b), (c, d) = np.exp(step - step.max()).tolist()
    ahead, x, y = [], 0.5, 0.5
    for i, (p, q) in enumerate(e):
        x, y = (p, q) if i == 0 else ((x * a + y * c) * p, (x * b + y * d) * q)
        s = x + y
        x, y = x / s, y / s
        ahead.append((x, y))
    out, u, v = [], 1.0, 1.0
    for i in range(len(e) - 1, -1, -1):
        p, q = ahead[i][0] * u, ahead[i][1] * v
        out.append((p / (p + q), q / (p + q)))
        g, h = e[i]
        u, v = a * g * u + b * h * v, c * g * u + d * h * v
        s = u + v
        u, v = u / s, v / s
    return np.array(out[::-1])


def batches_of(chains: list[tuple[np.ndarray, int]]):
    """Chains of similar length together: (features (B, T, F), mask (B, T), labels (B,))."""
    chains = sorted(chains, key=lambda c: len(c[0]))
    at = 0
    while at < len(chains):
        end = at
        while end < len(chains) and len(chains[end][0]) <= 1.3 * len(chains[at][0]) + 1:
            end += 1
        part = chains[at:end]
        x = np.zeros((len(part), len(part[-1][0]), part[0][0].shape[1]))
        mask = np.zeros(x.shape[:2], bool)
        for i, (f, _) in enumerate(part):
            x[i, : len(f)], mask[i, : len(f)] = f, True
        yield x, mask, np.array([y for _, y in part])
        at = end


def gradient(x, mask, y, w, step) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of all-y chains, for the weights of features (of state 1 against 0) and of steps."""
    b, t, _ = x.shape
    emit = np.zeros((b, t, 2))
    emit[..., 1] = x @ w
    ahead, back = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    add = lambda a: np.logaddexp(a[..., 0, :], a[..., 1, :])
    ahead[:, 0] = emit[:, 0]
    for i in range(1, t):
        ahead[:, i] = np.where(mask[:, i, None], add(ahead[:, i - 1, :, None] + step) + emit[:, i], ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        follow = (emit[:, i + 1] + back[:, i + 1])[:, None, :] + step
        back[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(follow[..., 0], follow[..., 1]), 0)
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    good = np.exp(ahead[..., 1] + back[..., 1] - whole[:, None]) * mask
    of_w = np.einsum("btf,bt->f", x, (y[:, None] - good) * mask)
    of_step = np.zeros((2, 2))
    pairs = mask[:, 1:].sum(1)
    for i in range(1, t):
        p = np.exp(ahead[:, i - 1, :, None] + step + (emit[:, i] + back[:, i])[:, None, :] - whole[:, None, None])
        of_step -= p[mask[:, i]].sum(0)
    of_step[0, 0] += pairs[y == 0].sum()
    of_step[1, 1] += pairs[y == 1].sum()
    return of_w, of_step


def train(chains: list[tuple[np.ndarray, int]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of steps, by Adam on the whole sample."""
    w, step = np.zeros(len(FEATURES)), np.zeros((2, 2))
    if not chains:
        return w, step
    parts = list(batches_of(chains))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, steps + 1):
        g = -penalty * np.concatenate([w, step.ravel()])
        for part in parts:
            of_w, of_step = gradient(*part, w, step)
            g += np.concatenate([of_w, of_step.ravel()])
        g /= len(chains)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - i / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, step = w + move[: len(w)], step + move[len(w) :].reshape(2, 2)
    return w, step


def document_score(text: str | None, w: np.ndarray, step: np.ndarray) -> float:
    x, sizes = line_features(text)
    emit = np.zeros((len(x), 2))
    emit[:, 1] = np.clip(x @ w, -500, 500)
    good = forward_backward(emit, step)[:, 1]
    return float(min(1.0, max(0.0, math.fsum(good * sizes) / sizes.sum())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, **options) -> tuple[np.ndarray, np.ndarray]:
    """Learns from labels (doc_id, quality) of docs (doc_id, text)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    few = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches):
        for batch in batches:
            found = [line_features(x)[0] for x in batch.column(1).to_pylist()]  # ones and zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype(np.uint8).tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())], names=["doc_id", "quality", "x", "n"])

    joined = docs.select("doc_id", "text").join(F.broadcast(few.distinct()), "doc_id")  # sample rows at most
    # an id's rows may be any number: the text with the smallest digest stands for them
    single = joined.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("of")).select("doc_id", "of.text", "quality")
    each = cut(single.mapInArrow(run, "doc_id long, quality int, x binary, n long"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").rowsBetween(Window.unboundedPreceding, 0)  # a row per labelled document of the sample
    rows = each.withColumn("reach", F.sum("n").over(order)).where(F.col("reach") <= lines).select("x", "quality").collect()
    chains = [(np.frombuffer(r["x"], np.uint8).reshape(-1, len(FEATURES)).astype(float), r["quality"]) for r in sorted(rows, key=lambda r: (bytes(r["x"]), r["quality"]))]
    return train(chains, **options)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], into: str = "score") -> DataFrame:
    """docs with the score as a column called into, in place of one of that name."""
    w, step = model
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(into, F.lit(0.0)).schema
    at = kept.index("text")

    def run(batches):
        for batch in batches:
            scores = pa.array([document_score(x.as_py(), w, step) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, into])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
