"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + <w, x> + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]); the
bracket is the sum-of-squares identity for all pairwise interactions <v_i, v_j> x_i x_j, so
scoring is linear in the number of features.

Features of a text: words and word endings hashed to ``WORD_SLOTS`` slots (log counts of
each, scaled to length one), statistics of its structure (shares of character classes,
word and line lengths, repetition), and one metadatum, the declared ``n_chars``. Labels,
language, source and id are never features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Slots of hashed words; the structure statistics and metadata follow them.
WORD_SLOTS = 1 << 16
#: Rank of the interactions.
RANK = 8
#: Most labelled rows learnt from: those of the smallest hash of their id. Bounds what reaches the driver.
TRAIN_ROWS = 8000
EPOCHS = 12
BATCH = 64
RATE = 0.05
DECAY = 1e-4
SEED = 17
#: A document is kept from this score on.
THRESHOLD = 0.3
CACHED_WORDS = 1 << 16
_ROW = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (0 if _i >= 128 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c in " \t\r\v\f"
        else 5 if _c == "\n" else 6 if _c in ".,;:'\"-()?" else 7)
#: Statistics: 8 byte classes, 12 more, 3 of metadata, each in as many steps as below.
STEPS = 8
N_STATS = 23
SLOTS = WORD_SLOTS + N_STATS * (STEPS + 1)


def statistics(text: str, n_words: int, counts: Counter, declared: int | None) -> np.ndarray:
    """Structure statistics and metadata of a text, each between 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    classes = np.bincount(_CLASS[raw], minlength=8) if len(raw) else np.zeros(8, dtype=np.int64)
    n, words = max(1, len(raw)), max(1, n_words)
    lines = text.split("\n") if text else []
    kinds = Counter(lines)
    odd_ends = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
    short = sum(c for w, c in counts.items() if len(w) == 1)
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ends = classes[6] / words
    shares = [
        *(classes / n),
        len(counts) / words, odd_ends / words, short / words, caps / words, min(1.0, ends),
        min(1.0, (n / words) / 20), min(1.0, np.log1p(n_words) / 10), min(1.0, np.log1p(len(lines)) / 8),
        1 - len(kinds) / max(1, len(lines)), max(counts.values(), default=0) / words,
        float(not text.strip()), min(1.0, (n_words / max(1, len(lines))) / 100),
        0.0 if declared is None else min(1.0, np.log1p(max(0, declared)) / 14), float(declared is None),
        0.0 if declared is None else min(1.0, abs(declared - len(text)) / max(1, len(text))),
    ]
    return np.asarray(shares, dtype=np.float32)


class Featuriser:
    """Texts to (slots, values); one a worker, as it remembers words' slots."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def slot(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
            if len(word) <= 64:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = got
        return got

    def __call__(self, text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        stats = statistics(text, len(words), counts, declared)
        slot = self.slot
        hashed = np.fromiter((slot(w) for w in counts), np.int32, len(counts))
        weight = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        if len(hashed):
            weight /= np.sqrt((weight**2).sum())
        # A statistic is itself a feature, and so is the step of its range that it lies in.
        base = WORD_SLOTS + np.arange(N_STATS, dtype=np.int32) * (STEPS + 1)
        step = base + 1 + np.minimum((np.sqrt(stats) * STEPS).astype(np.int32), STEPS - 1)
        slots = np.concatenate([hashed, base, step])
        return slots, np.concatenate([weight, stats, np.full(N_STATS, 0.5, np.float32)]).astype(np.float32)


@dataclass
class Machine:
    """A factorisation machine: bias, linear weights (SLOTS) and factors (SLOTS x RANK)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        """The argument of the sigmoid, in time linear in the features."""
        v = self.factors[slots] * values[:, None]
        sums = v.sum(0)
        return float(self.bias + self.linear[slots] @ values + 0.5 * (sums @ sums - (v * v).sum()))

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(slots, values), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Learn by AdaGrad on the logistic loss, in a fixed order: the same rows give the same machine.

    Both classes weigh the same in sum up to a factor of four. Without rows, or with one
    class only, the machine answers with the share of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(SEED)
    linear = np.zeros(SLOTS, np.float64)
    factors = rng.normal(0, 0.01, (SLOTS, RANK))
    n = len(rows)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    machine = Machine(float(np.log(share / (1 - share))), linear, factors)
    if not n or labels.min() == labels.max():
        factors[:] = 0
        return machine
    weight = np.where(labels == 1, 1.0, min(4.0, labels.sum() / max(1, n - labels.sum())))
    seen_l, seen_f, seen_b = np.full(SLOTS, 1e-2), np.full((SLOTS, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at : at + BATCH]
            slots = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some]).astype(np.float64)
            sizes = np.array([len(rows[i][0]) for i in some])
            start = np.r_[0, sizes.cumsum()[:-1]]
            row = np.repeat(np.arange(len(some)), sizes)
            v = factors[slots]
            vx = v * x[:, None]
            sums = np.add.reduceat(vx, start)
            margin = machine.bias + np.add.reduceat(linear[slots] * x, start) + 0.5 * ((sums**2)
                .sum(1) - np.add.reduceat((vx**2).sum(1), start))
            pull = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) * weight[some] / len(some)
            used, place = np.unique(slots, return_inverse=True)
            g_l = np.bincount(place, pull[row] * x, len(used)) + DECAY * linear[used]
            each = (pull[row] * x)[:, None] * (sums[row] - vx)
            g_f = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * factors[used]
            seen_l[used] += g_l**2
            seen_f[used] += g_f**2
            seen_b += pull.sum() ** 2
            linear[used] -= RATE * g_l / np.sqrt(seen_l[used])
            factors[used] -= RATE * g_f / np.sqrt(seen_f[used])
            machine.bias -= RATE * pull.sum() / np.sqrt(seen_b)
    return machine


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 0 modulo 5; a null id is held out too, so that it is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``limit`` labelled documents that aren't held out, of the smallest xxhash64 of their id.

    Labels other than 0 and 1 are left out; of several labels of a document the smallest
    counts, and of rows that repeat an id those of the smallest features. The labels' side of
    the join has at most ``limit`` rows, so it is broadcast; one row a chosen id goes to the
    driver, so their number is bounded too.
    """
    pool = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = pool.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality")
        .alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", docs["n_chars"].cast("long").alias("n_chars"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", F.col("quality").cast("int")
        .alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            found = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array([s.tobytes() for s, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "quality", "slots", "x"],
            )

    made = map_batches(joined, run, "doc_id long, quality int, slots binary, x binary")
    got = made.groupBy("doc_id").agg(F.min(F.struct("slots", "x", "quality")).alias("r")).select("doc_id", "r.*").toArrow()
    table = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "slots", "x", "quality"))))
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(x, np.float32)) for _, s, x, _ in table]
    return fit(rows, np.array([q for *_, q in table], dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by its whole text; a null text counts as empty.

    A null n_chars is a feature of its own; repeated rows stay repeated; other columns are
    ignored. The machine has a fixed size; rows are scored one by one, without a shuffle.
    """
    small = Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            scores = np.array([small.score(*features(t, n))
                for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(scores),
                pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", docs["n_chars"].cast("long")
        .alias("n_chars"), held_out(docs["doc_id"]).alias("held_out"))
    return map_batches(texts, run, _ROW)


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that the machine scores at THRESHOLD or more, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            names = batch.schema.names
            texts, sizes = batch.column(names.index("text")).to_pylist(), batch.column(names.index("n_chars")).to_pylist()
            yield batch.filter(pa.array([small.score(*features(t, n)) >= THRESHOLD for t, n in zip(texts, sizes)], pa.bool_()))

    small = Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))
    return map_batches(docs, run, docs.schema)
