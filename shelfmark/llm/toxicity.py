"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two strings are alike by the three-character subsequences they share, each weighted by LAMBDA to the number of characters
it leaves out, up to SPAN characters in all: "idiot", "id.i.ot" and "idxiot" share most of theirs. Units are words (and
runs of single letters, "i d i o t"). Nyström landmarks turn the kernel into features K_mm^(-1/2) k(x, landmarks), on
which a linear support vector machine is trained. As the kernel is an inner product of known (three characters) features,
machine and landmarks fold into one table of 32^3 weights, so that scoring needs one pass over a text.

Labels are those of documents; which sentence makes a document toxic is not known. Training therefore alternates between
choosing, in each toxic document, the sentence and in it the unit that the machine finds worst, and training on these
against the worst and some ordinary units of clean documents' sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffer_of, documents, fold, plus, small_batches

#: Bounds of the training sample: toxic documents, and clean documents for each of these.
SAMPLE_DOCS = 2000
CLEAN_SHARE = 3
LANDMARKS = 384
ROUNDS = 4
LAMBDA = 0.6
SPAN = 5
#: Longer units are read in windows of so many bytes, so that an insult stands out in a long run of characters.
LONGEST = 48
#: Bytes from one window to the next: an insult of up to LONGEST - STRIDE bytes lies whole in some window wherever it stands.
STRIDE = 16
#: Least likeness of a unit to itself: that of three letters side by side. Shorter units score the bias.
SMALLEST = 1.0
MARK = 27
#: Training rows, and units, whose features are held at once.
BLOCK = 256
#: Units whose features are held at once while training (128 kB each).
FEATURED = 64

_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

# A class of 1-31 for each byte. Letters have their own, figures and marks that stand for letters that
# letter's, other marks 27; bytes of characters beyond ASCII share 28-31.
_CLASS = np.full(256, 27, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
for _mark, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _CLASS[ord(_mark)] = ord(_letter) - 96
_CLASS[128:] = 28 + np.arange(128) % 4
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the bytes (0: a blank between units), starts of the units, (start, end) of the windows, and n+1 window
    offsets by row.

    A blank between two words of one character each joins them. No unit crosses rows. A unit of up to LONGEST bytes is one
    window, a longer one has a window of LONGEST bytes every STRIDE bytes until its end is reached.
    """
    n = len(data)
    solid = np.zeros(n + 4, bool)
    solid[2 : n + 2] = ~_BLANK[data]
    here = slice(2, n + 2)
    soft = ~solid[here] & solid[1 : n + 1] & ~solid[0:n] & solid[3 : n + 3] & ~solid[4 : n + 4]
    inside = solid[here] | soft
    starts = inside & ~np.concatenate(([False], inside[:-1]))
    borders = offsets[offsets < n]
    starts[borders] = inside[borders]
    classes = np.where(inside, _CLASS[data], 0).astype(np.uint8)
    first = np.flatnonzero(starts)
    gaps = np.append(np.flatnonzero(~inside), n)
    ends = np.minimum(np.append(first[1:], n)[: len(first)], gaps[np.searchsorted(gaps, first)])
    held = 1 + np.maximum(0, -(-(ends - first - LONGEST) // STRIDE))
    begin = np.repeat(first, held) + STRIDE * (np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held))
    windows = np.stack((begin, np.minimum(begin + LONGEST, np.repeat(ends, held))), axis=1)
    return classes, first, windows, np.searchsorted(begin, offsets)


def occurrences(classes: np.ndarray, first: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern of gaps: its weight, the positions where it lies within a unit, and the features there.

    The three characters are letters; marks (class 27) only ever lie in the gaps.
    """
    n = len(classes)
    unit = np.zeros(n, np.int32)
    unit[first] = 1
    unit = np.cumsum(unit, dtype=np.int32)
    wide = classes.astype(np.int32)
    letter = (classes > 0) & (classes != MARK)
    for a, b in _PATTERNS:
        if n <= b:
            continue
        at = np.flatnonzero((unit[:-b] == unit[b:]) & letter[:-b] & letter[a : n - b + a] & letter[b:])
        yield LAMBDA ** (b - 2), at, (wide[at] << 10) | (wide[at + a] << 5) | wide[at + b]


@dataclass(frozen=True)
class ToxicityModel:
    """Folded weights of the machine, its bias, and the logistic curve from a document's worst unit to a score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def decisions(self, classes: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The machine's decision for each window, over the subsequences of its unit that start in it. Its likeness to itself
        takes its subsequences as distinct."""
        if not len(first):
            return np.zeros(0)
        each, own = np.zeros(len(classes) + 1, np.float32), np.zeros(len(classes) + 1, np.float32)
        for weight, at, feature in occurrences(classes, first):
            each[at] += np.float32(weight) * self.weights[feature]
            own[at] += np.float32(weight * weight)
        edges = windows.ravel()
        return np.add.reduceat(each, edges)[::2] / np.sqrt(np.maximum(np.add.reduceat(own, edges)[::2], SMALLEST)) + self.bias

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The worst decision of each row; a row without units has the bias."""
        classes, first, windows, bounds = units(data, offsets)
        found = np.append(self.decisions(classes, first, windows), -np.inf)
        out = np.full(len(offsets) - 1, self.bias)
        some = bounds[1:] > bounds[:-1]
        if some.any():
            out[some] = np.maximum.reduceat(found, bounds[:-1][some])
        return out

    def scores(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.shift, -50, 50)))


def _features(units_of: list[bytes]) -> np.ndarray:
    """Feature vectors of units, over the features that any of them has; rows have length one."""
    data = np.frombuffer(b"".join(units_of), np.uint8)
    ends = np.cumsum([len(u) for u in units_of])
    first = np.concatenate(([0], ends[:-1])).astype(np.int64)
    classes = np.where(_BLANK[data], 27, _CLASS[data]).astype(np.uint8)
    row_of = np.repeat(np.arange(len(units_of)), [len(u) for u in units_of])
    out, own = np.zeros((len(units_of), 1 << 15), np.float32), np.zeros(len(units_of))
    for weight, at, feature in occurrences(classes, first):
        np.add.at(out, (row_of[at], feature), np.float32(weight))
        np.add.at(own, row_of[at], weight * weight)
    out /= np.sqrt(np.maximum(own, SMALLEST))[:, None].astype(np.float32)
    return out


def _disturbed(unit: bytes, chance: np.random.Generator) -> list[bytes]:
    """The unit as it may be disguised: marks between its characters, and one foreign character within."""
    at = int(chance.integers(1, max(2, len(unit))))
    return [b".".join(unit[i : i + 1] for i in range(len(unit))), unit[:at] + bytes([97 + int(chance.integers(26))]) + unit[at:]]


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps over its support vectors; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active][:, None]
        new = np.linalg.solve(ridge + xa.T @ (xa * wa), xa.T @ (wa[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """A model from texts and labels (1: toxic). Without both labels, every text gets the share of toxic rows."""
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if not len(rows) or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.0
        return ToxicityModel(np.zeros(1 << 15, np.float32), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    def blocks() -> Iterator[tuple]:
        """(labels, bytes, offsets of rows, classes, starts of units, windows, window offsets of rows), made anew each time:
        they are many times as large as the texts."""
        for at in range(0, len(rows), BLOCK):
            data, offsets = buffer_of(pa.array([t for t, _ in rows[at : at + BLOCK]], pa.string()))
            yield labels[at : at + BLOCK], data, offsets, *units(data, offsets)

    # First guess: how much more often a feature is in toxic than in clean documents.
    counts = np.zeros((2, 1 << 15))
    for label, _, offsets, classes, first, *_ in blocks():
        row_of = np.repeat(np.arange(len(label)), np.diff(offsets))
        seen = np.zeros((len(label), 1 << 15), bool)
        for _, at, feature in occurrences(classes, first):
            seen[row_of[at], feature] = True
        counts += [seen[label == y].sum(axis=0) for y in (0, 1)]
    odds = np.log((counts[1] + 0.5) / (labels.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - labels).sum() + 1))
    odds[counts.sum(axis=0) == 0] = 0
    model = ToxicityModel(odds.astype(np.float32), 0.0, 1.0, 0.0)
    chance = np.random.default_rng(7)
    for turn in range(rounds):
        worst, clean, ordinary = set(), set(), set()
        for label, data, _, classes, first, windows, bounds in blocks():
            decisions = model.decisions(classes, first, windows)
            text_of = lambda i: data[windows[i, 0] : windows[i, 1]].tobytes().lower().strip()  # noqa: E731, B023
            for row in np.flatnonzero(bounds[1:] > bounds[:-1]):
                top = bounds[row] + int(np.argmax(decisions[bounds[row] : bounds[row + 1]]))
                (worst if label[row] else clean).add(text_of(top))
                if not label[row]:
                    ordinary.add(text_of(int(chance.integers(bounds[row], bounds[row + 1]))))
        known = {u for u in clean | ordinary if len(u) > 2}
        negative = sorted(known)
        positive = sorted(u for u in worst if len(u) > 2 and u not in known)
        if not positive or not negative:
            break
        half = min(len(positive), landmarks // 2)
        chosen = [positive[i] for i in chance.choice(len(positive), half, replace=False)]
        chosen += [negative[i] for i in chance.choice(len(negative), min(len(negative), landmarks - half), replace=False)]
        marks = _features(chosen)
        positive += [v for u in positive for v in _disturbed(u, chance) if v not in known] if turn else []
        both = positive + negative
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = np.concatenate([_features(both[i : i + FEATURED]) @ marks.T for i in range(0, len(both), FEATURED)]).astype(np.float64) @ root
        w, bias = _machine(x, np.where(np.arange(len(both)) < len(positive), 1.0, -1.0))
        model = ToxicityModel((marks.T @ (root @ w).astype(np.float32)).astype(np.float32), bias, 1.0, 0.0)
    slope, shift = _curve(np.concatenate([model.worst(data, offsets) for _, data, offsets, *_ in blocks()]), labels)
    return ToxicityModel(model.weights, model.bias, slope, shift)


def _curve(decisions: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through decisions and labels, both labels weighing alike."""
    target = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    x = np.stack([decisions, np.ones_like(decisions)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit on a bounded sample: at most ``sample`` toxic and three times as many clean documents, by the smallest hashes of their ids,
    each with its whole text. Rows without a text, a label or an id teach nothing; of repeated label
    rows of a document the highest counts. Only sampled ids meet the texts, as a broadcast of at most 4 * sample ids.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = F.xxhash64(F.col("doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [
        known.where((F.col("toxic") == y) & (hashed <= min(2**63 - 1, -(2**63) + int(min(1.0, 1.2 * most / n) * 2**64)))).orderBy(hashed, "doc_id").limit(most)
        for y, n in sorted(counts.items())
        for most in [sample if y else CLEAN_SHARE * sample]
    ]
    if not parts:
        return fit([])
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").distinct()
    return fit([(r["text"], int(r["toxic"])) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))][: 4 * sample])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), read from the whole text alone; null, empty and blank texts get the score of no unit.

    Every row and column is kept, a column called ``score`` is replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(model.worst(*buffer_of(batch.column(names.index(text)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, plus(docs.schema, score="double"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fold, score and the prediction at 0.7. Learns from ids whose crc32 modulo 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold("doc_id", 3) != 1)
    model = train(documents(spark, sf_dir, "doc_id", "text"), labels)
    found = score(documents(spark, sf_dir, "doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
