"""Language-model scoring with a weighted backoff automaton over words, which spells the words it does not know.

The states are the words of the training texts (and the start of a text); a state's arcs are the tokens seen after it, so
states and arcs grow with the corpus. A failure arc leads from each state to the one without context, whose arcs are all
known tokens, and a second one from there to the spelling of a token. Failure weights are Witten-Bell's (how many different
tokens followed, against how often), shared by states of about the same count, as many words are too rare for a weight of
their own. Arcs and states are tables of counts, met by hashes of 64 bits; none is dropped. Each block of texts gets the
counts of its own words and pairs, in the order in which it named them, and one traversal from left to right carries the state and adds up log10 probabilities.

The spelling is an automaton over bytes: its states are the contexts (up to ORDER - 1 bytes) that make up at least SHARE of
all training positions, with Witten-Bell failure arcs that are followed once, when it is built. It is small enough to be
sent to every task, and decides only how a token's share of what words left over is divided. A sequence of words has exactly
one spelling, so for each state the tokens' probabilities add up to one at most (the rest is that of an empty word).

Word counts for the base score, and byte counts for the spelling, are taken over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffer_of, documents, fold, lowered, mix, slices, small_batches, word_hashes, word_spans
from shelfmark.session import checkpoint, passing

#: Bytes of an n-gram: five of context and the next.
ORDER = 6
#: A context is a state if at least this share of positions follows it, so an order has 2^16 states at most.
SHARE = 2.0**-16
#: Bytes of text whose words are counted together; also what a worker holds while it scores.
BLOCK_BYTES = 8 << 20
#: Bytes that one lane of the traversal reads; a lane begins with the ORDER - 1 bytes before it, which fix its state.
LANE = 256
_BLANK, _END = 0x20, 0x0A
#: Stands for the end and the start of a text among hashed words.
_END_WORD, _START_WORD = np.uint64(0x0A), np.uint64(0x02)
#: A pair's hash begins with so many bits of its state's, and as many come along with it; both tell the states of arcs.
STATE_BITS = 16
#: States share a failure weight if their counts lie between the same powers of the square root of two.
LEVELS = 2


@dataclass
class Spelled:
    """Texts as the model reads them: lower case, each word followed by one blank, an end after the last."""

    data: np.ndarray  # every row is preceded by ORDER - 1 ends
    first: np.ndarray  # of each row
    last: np.ndarray  # behind each row's end
    hashes: np.ndarray  # of the words
    words: np.ndarray  # n+1 word offsets of the rows
    puts: np.ndarray  # of each word

    @property
    def rows(self) -> np.ndarray:
        """The row of each token; tokens are a row's words and its end."""
        return np.repeat(np.arange(len(self.first)), np.diff(self.words) + 1)

    def tokens(self, of_words: np.ndarray, of_ends: np.ndarray | int) -> np.ndarray:
        """One value a token, from those of the words and of the ends."""
        n = len(self.first)
        out = np.empty(len(of_words) + n, of_words.dtype)
        out[self.words[1:] + np.arange(n)] = of_ends
        out[np.arange(len(of_words)) + np.repeat(np.arange(n), np.diff(self.words))] = of_words
        return out

    def before(self, tokens: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Each token's predecessor's value; ``start`` for the first of a row."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[self.words[:-1] + np.arange(len(self.first))] = start
        return out

    def pairs(self) -> np.ndarray:
        """A hash for each token with its predecessor: its first STATE_BITS bits are the predecessor's."""
        tokens = self.tokens(self.hashes, _END_WORD)
        states = self.before(tokens, _START_WORD)
        low = np.uint64((1 << 64 - STATE_BITS) - 1)
        with np.errstate(over="ignore"):
            return (states << np.uint64(64 - 2 * STATE_BITS) & ~low) | (mix(states * np.uint64(3) + mix(tokens)) & low)


def spell(column: pa.Array) -> Spelled:
    data, offsets = buffer_of(column)
    data = lowered(data)
    starts, ends, bounds = word_spans(data, offsets)
    widths = ends - starts
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    before = np.concatenate(([0], np.cumsum(widths + 1)))
    put = before[:-1] + ORDER * (row + 1) - 1
    out = np.full(int(before[-1]) + ORDER * len(column), _END, np.uint8)
    step = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    out[np.repeat(put, widths) + step] = data[np.repeat(starts, widths) + step]
    out[put + widths] = _BLANK
    rows = np.arange(len(column))
    return Spelled(out, before[bounds[:-1]] + ORDER * (rows + 1) - 1, before[bounds[1:]] + ORDER * (rows + 1), word_hashes(data, starts, ends), bounds, put)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, held): how often each ORDER bytes (first byte highest) occur in the texts, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                s = spell(part)
                n = len(s.data) - ORDER + 1
                packed = np.zeros(n, np.uint64)
                for k in range(ORDER):
                    packed = (packed << np.uint64(8)) | s.data[k : k + n]
                own = np.zeros(len(s.data) + 1, np.int32)
                own[s.first] += 1
                own[s.last] -= 1
                found, often = np.unique(packed[np.cumsum(own)[ORDER - 1 : ORDER - 1 + n] > 0], return_counts=True)
                both, place = np.unique(np.concatenate((kinds, found)), return_inverse=True)
                kinds, times = both, np.bincount(place, np.concatenate((times, often)), len(both)).astype(np.int64)
                if len(kinds) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], ["gram", "held"])
                    kinds, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], ["gram", "held"])

    return docs.select("text").mapInArrow(count, "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held"))


@dataclass(frozen=True)
class Automaton:
    """weight[state, class]: log10 probability of a byte of the class; follow[state, class]: the next state."""

    classes: np.ndarray
    weight: np.ndarray
    follow: np.ndarray

    def spellings(self, s: Spelled) -> np.ndarray:
        """The log10 probability of each token's spelling, its blank included, after the bytes before it."""
        if not len(s.first):
            return np.zeros(0)
        lengths = s.last - s.first
        lanes = -(-lengths // LANE)
        row = np.repeat(np.arange(len(lengths)), lanes)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        left = np.minimum(LANE, lengths[row] - at)
        order = np.argsort(-left, kind="stable")
        row, left = row[order], left[order]
        place = (s.first[row] + at[order]) - (ORDER - 1)
        symbols = self.classes[s.data].astype(np.int64)
        width = self.weight.shape[1]
        weight, follow = self.weight.ravel(), self.follow.ravel()
        sums, state = np.zeros(len(s.data) + 1), np.zeros(len(row), np.int64)
        for step in range(ORDER - 1 + int(left[0])):
            live = len(row) if step < ORDER else int(np.searchsorted(-left, -(step - ORDER + 1), side="left"))
            arc = state[:live] * width + symbols[place[:live] + step]
            if step >= ORDER - 1:
                sums[1 + place[:live] + step] = weight[arc]
            state[:live] = follow[arc]
        np.cumsum(sums, out=sums)
        starts = s.tokens(s.puts, s.last - 1)
        stops = np.append(starts[1:], 0)
        stops[s.words[1:] + np.arange(len(s.first))] = s.last
        return sums[stops] - sums[starts]


def build(grams: DataFrame, share: float = SHARE) -> Automaton:
    """The automaton of the counts. Comes to the driver: arcs of the states, at most (ORDER - 1) * 2^16 * 256, by far fewer."""
    total = grams.agg(F.sum("held")).first()[0] or 0
    least = max(1.0, total * share)
    orders = grams.select("held", F.posexplode(F.array(*[F.col("gram").bitwiseAND(F.lit((1 << 8 * (n + 1)) - 1)) for n in range(ORDER)])).alias("n", "part"))
    parts = checkpoint(orders.groupBy("n", "part").agg(F.sum("held").alias("held")))
    context = F.shiftrightunsigned("part", 8)
    states = parts.groupBy("n", context.alias("context")).agg(F.sum("held").alias("all")).where((F.col("all") >= least) | (F.col("n") == 0))
    arcs = parts.select("n", context.alias("context"), F.col("part").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "held").join(states, ["n", "context"]).toPandas()
    return _automaton(arcs, least)


def _automaton(arcs: pd.DataFrame, least: float) -> Automaton:
    root = arcs[arcs.n == 0]
    common = np.sort(root.byte[root.held >= least].to_numpy(np.int64))
    classes = np.full(256, len(common), np.int64)  # the last class holds all other bytes
    classes[common] = np.arange(len(common))
    sizes = np.bincount(classes, minlength=len(common) + 1).astype(float)
    width = len(sizes)
    found = arcs[["n", "context"]].drop_duplicates().sort_values(["n", "context"]).to_numpy(np.int64)
    number = {(int(n), int(c)): i for i, (n, c) in enumerate(found)} or {(0, 0): 0}
    if not len(found):
        found = np.array([[0, 0]])
    share = np.zeros((len(found), width))
    if len(arcs):
        row = np.array([number[k] for k in zip(arcs.n.tolist(), arcs.context.tolist(), strict=True)])
        np.add.at(share, (row, classes[arcs.byte.to_numpy(np.int64)]), arcs.held.to_numpy(float))
    seen = (share > 0).sum(axis=1)
    follow = np.zeros((len(found), width), np.int32)
    by_parent: dict[int, list[tuple[int, int]]] = {}
    for i, (n, c) in enumerate(found.tolist()):
        if n and (parent := number.get((n - 1, c >> 8))) is not None:
            by_parent.setdefault(parent, []).append((int(classes[c & 255]), i))
    rest = width - 1
    for i, (n, c) in enumerate(found.tolist()):  # shorter contexts first, so the failure state is ready
        fail = number[n - 1, c & ((1 << 8 * (n - 1)) - 1)] if n else -1
        below = share[fail] if n else sizes / 256
        own = share[i].sum()
        share[i] = (share[i] + max(seen[i], 1) * below) / (own + max(seen[i], 1))
        follow[i] = follow[fail] if n else 0
        for symbol, state in by_parent.get(i, ()):
            if symbol != rest:
                follow[i, symbol] = state
    with np.errstate(divide="ignore"):
        weight = np.log10(share / np.maximum(sizes, 1))
    return Automaton(classes.astype(np.uint8 if width < 256 else np.int16), np.where(np.isfinite(weight), weight, -99.0).astype(np.float32), follow)


def _counted(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each is first met, and how many of its places are marked."""
    kinds, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return kinds, first, np.bincount(place, learns, len(kinds)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets of some hashes, and the places of each one's hashes in their order. Bits of a pair's state do not count."""
    bucket = ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return np.array([bucket[p[0]] for p in parts], np.int64), parts


def _packed(values: np.ndarray) -> bytes:
    """Numbers as the bytes that the largest takes, first the lowest byte of each, which compresses better."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _block_counts(placed: DataFrame, buckets: int) -> DataFrame:
    """Each block's words (``pair`` 0) and pairs (1) with their training counts in it, as arrays dealt by hash into buckets.
    They are sorted, so the block can tell which its counts are without getting them back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, pairs, states, marks, token_marks = None, [], [], [], [], []

        def settle() -> Iterator[pa.RecordBatch]:
            learns = np.concatenate(token_marks)
            found = [(0, *_counted(np.concatenate(words), np.concatenate(marks))), (1, *_counted(np.concatenate(pairs), learns))]
            state = np.concatenate(states)
            for kind, keys, first, here in found:
                bucket, parts = _dealt(keys, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket), pa.array([block] * len(parts), pa.int64()), pa.array([kind] * len(parts), pa.int32()),
                        pa.array([_packed(keys[p]) for p in parts], pa.binary()), pa.array([_packed(here[p]) for p in parts], pa.binary()),
                        pa.array([_packed(state[first[p]] if kind else np.zeros(0, np.uint16)) for p in parts], pa.binary()),
                    ],
                    ["bucket", "block", "pair", "keys", "here", "states"],
                )

        for batch in batches:
            block_of, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.diff(block_of)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block_of)], strict=True):
                if block_of[a] != block:
                    if words:
                        yield from settle()
                    block, words, pairs, states, marks, token_marks = int(block_of[a]), [], [], [], [], []
                for first, part in slices(batch.column(2).slice(a, b - a)):
                    s = spell(part)
                    mine = learn[a + first : a + first + len(part)]
                    words.append(s.hashes), pairs.append(s.pairs())
                    state = s.before(s.tokens(s.hashes, _END_WORD), _START_WORD)
                    states.append(state.astype(np.uint16))
                    marks.append(np.repeat(mine, np.diff(s.words))), token_marks.append(mine[s.rows])
        if words:
            yield from settle()

    kinds = "bucket long, block long, pair int, keys binary, here binary, states binary"
    return placed.select("block", "learns", "text").repartition("block").sortWithinPartitions("block").mapInArrow(count, kinds)


def _shared_counts(counts: DataFrame) -> DataFrame:
    """What the buckets add up to, in rows of three kinds (``pair``):

    * 0, 1: the counts, in all training texts, of a block's words or pairs of a bucket, in the order of their hashes; none
      if no other block has one of them;
    * 2: a state's number of arcs and their counts, part by part (``key``: 2 * STATE_BITS bits of its word, ``n`` arcs, ``total``);
    * 3: the number ``n`` of distinct training words of a bucket, and their ``total``.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def row(blocks, pair, counts, key, n, total):
            size = max(len(blocks), len(key))
            pad = lambda a, kind: pa.array(a, kind) if len(a) else pa.nulls(size, kind)
            return pa.RecordBatch.from_arrays(
                [pad(blocks, pa.int64()), pa.array([pair] * size, pa.int32()), pad([group[0]] * len(blocks), pa.int64()), pad(counts, pa.binary()), pad(key, pa.int64()), pad(n, pa.int64()), pad(total, pa.int64())],
                ["block", "pair", "bucket", "counts", "key", "n", "total"],
            )

        def settle() -> Iterator[pa.RecordBatch]:
            keys = [_unpacked(k) for _, k, _, _ in held]
            kinds, first, place, times = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
            total = np.bincount(place, np.concatenate([_unpacked(h) for _, _, h, _ in held]), len(kinds)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            for (block, *_), k, end in zip(held, keys, ends.tolist(), strict=True):
                mine = place[end - len(k) : end]
                if (times[mine] > 1).any():
                    yield row([block], group[1], [_packed(total[mine])], [], [], [])
            seen = total > 0
            if group[1]:
                state = np.concatenate([_unpacked(s) for *_, s in held])[first[seen]]
                state |= kinds[seen] >> np.uint64(64 - STATE_BITS) << np.uint64(STATE_BITS)
                found, at, arcs = np.unique(state, return_inverse=True, return_counts=True)
                if len(found):
                    yield row([], 2, [], found.astype(np.int64), arcs, np.bincount(at, total[seen], len(found)).astype(np.int64))
            else:
                yield row([], 3, [], [0], [int(seen.sum())], [int(total.sum())])

        for batch in batches:
            bucket_of, block_of, pair_of = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(batch)):
                if group != (bucket_of[i], pair_of[i]):
                    if held:
                        yield from settle()
                    group, held = (bucket_of[i], pair_of[i]), []
                held.append((block_of[i], *(batch.column(c)[i].as_py() for c in (3, 4, 5))))
        if held:
            yield from settle()

    kinds = "block long, pair int, bucket long, counts binary, key long, n long, total long"
    return counts.repartition("bucket").sortWithinPartitions("bucket", "pair").mapInArrow(add, kinds)


def _level(count: np.ndarray) -> np.ndarray:
    """The level of each count of at least one; equal for counts between the same powers of 2^(1 / LEVELS)."""
    return np.floor(LEVELS * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


def failure_weights(shared: DataFrame) -> np.ndarray:
    """For each level of a state's count, the different tokens that followed its states over all that followed."""
    states = shared.where("pair = 2").groupBy("key").agg(F.sum("n").alias("arcs"), F.sum("total").alias("held"))
    level = F.floor(LEVELS * F.log2("held") + 1e-9).cast("int")
    found = states.groupBy(level.alias("level")).agg((F.sum("arcs") / F.sum("held")).alias("rate")).collect()
    out = np.ones(64 * LEVELS)
    for row in found:
        out[row["level"]] = row["rate"]
    return out


def score_texts(docs: DataFrame, automaton: Automaton, learns: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: the key, ``learns`` (null: false), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of the whole text, A-Z in lower case, and one end. ``score`` is the log10 probability of the text
    by words after words, ``automaton`` spelling them where they fail; ``base_score`` adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))) with c the token's count in the texts that ``learns`` marks, N all their tokens
    and V the distinct ones. Words and pairs are counted by 64-bit hashes. Null and empty texts are an end alone; keys may be
    null or repeated; other columns are left out; an empty table gives an empty one. Without training texts the spelling
    is all there is.

    Texts are dealt into blocks of about ``block_bytes``. A block's words and pairs meet the counts of the whole, and only
    these counts come back to it, as numbers in the order of the hashes: no task holds more than a block, or a bucket of as many hashes and
    one more for each block that shares one of its most frequent words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(learns), F.lit(False)).alias("learns"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learns").cast("long")).alias("texts")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    placed = base.withColumn("block", F.pmod(F.xxhash64("key", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(blocks)))
    shared = checkpoint(_shared_counts(_block_counts(placed, blocks)))
    totals = shared.where("pair = 3").agg(F.sum("total").alias("n"), F.sum("n").alias("v")).first()
    rates = failure_weights(shared)
    learned = size["texts"] or 0
    all_tokens, distinct = (totals["n"] or 0) + learned, (totals["v"] or 0) + (1 if learned else 0)
    model = spark.sparkContext.broadcast(automaton)
    kind = base.schema["key"].dataType.simpleString()
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("key", kind), ("learns", "boolean"), ("text", "string"))]
    counts = shared.where("pair < 2").select("block", F.col("pair").alias("part"), "bucket", "counts", *empty)
    rows = placed.select("block", F.lit(2).alias("part"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "key", "learns", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's shared counts before its texts."""
        automaton = model.value
        block, known, texts = None, ([], []), []

        def count_of(keys: np.ndarray, marks: np.ndarray, pair: int) -> tuple[np.ndarray, np.ndarray]:
            """The place of each key among the distinct ones, and these ones' counts in all training texts."""
            kinds, place = np.unique(keys, return_inverse=True)
            count = np.bincount(place, marks, len(kinds))
            if known[pair]:
                parts = dict(zip(*(list(x) for x in _dealt(kinds, blocks)), strict=True))
                for bucket, counts in known[pair]:
                    count[parts[bucket]] = _unpacked(counts)
            return place, count

        def settle() -> Iterator[pa.RecordBatch]:
            words = np.concatenate([s.hashes for *_, s, _ in texts])
            marks = np.concatenate([np.repeat(learn, np.diff(s.words)) for _, learn, s, _ in texts])
            place, count = count_of(words, marks, 0)
            end = len(count)
            count = np.append(count, learned)  # ends; as many starts
            pair_place, pair_count = count_of(np.concatenate([s.pairs() for *_, s, _ in texts]), np.concatenate([learn[s.rows] for _, learn, s, _ in texts]), 1)
            at, pair_at = 0, 0
            for keys, learn, s, spelt in texts:
                n = len(s.first)
                token = s.tokens(place[at : at + len(s.hashes)], end)
                own, both = count[token], pair_count[pair_place[pair_at : pair_at + len(token)]]
                before = count[s.before(token, end)]
                at, pair_at = at + len(s.hashes), pair_at + len(token)
                with np.errstate(divide="ignore"):
                    one = spelt * np.log(10)
                    if all_tokens:
                        one = np.logaddexp(np.log(own), np.log(distinct) + one) - np.log(all_tokens + distinct)
                    arcs = np.maximum(before, 1) * rates[_level(before)]
                    two = np.where(before > 0, np.logaddexp(np.log(both), np.log(arcs) + one) - np.log(before + arcs), one)
                sums = lambda values: np.bincount(s.rows, values, n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(learn), pa.array(np.diff(s.words) + 1), pa.array(sums(own > 0).astype(np.int64)), pa.array(sums(np.log10(own + 0.5))), pa.array(sums(two) / np.log(10))],
                    ["key", "learns", "n_tokens", "n_known", "logs", "score"],
                )

        for batch in batches:
            block_of, part_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block_of) != 0) | (np.diff(part_of) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block_of)], strict=True):
                if block_of[a] != block:
                    if texts:
                        yield from settle()
                    block, known, texts = block_of[a], ([], []), []
                piece = batch.slice(a, b - a)
                if part_of[a] < 2:
                    known[part_of[a]].extend(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True))
                    continue
                learn = piece.column(5).to_numpy(zero_copy_only=False).astype(bool)
                for first, some in slices(piece.column(6)):
                    s = spell(some)
                    spelt = automaton.spellings(s)
                    s.data = s.data[:0]
                    texts.append((piece.column(4).slice(first, len(some)), learn[first : first + len(some)], s, spelt))
        if texts:
            yield from settle()

    found = counts.unionByName(rows).repartition("block").sortWithinPartitions("block", "part")
    found = found.mapInArrow(run, f"key {kind}, learns boolean, n_tokens long, n_known long, logs double, score double")
    divisor = float(np.log10(all_tokens + 0.5 * (distinct + 1)))
    return found.select(
        F.col("key").alias(key), "learns", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), "score",
    )


def language_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, scored by a model learnt from those whose id's crc32 modulo 5 is not 1."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("in_training", F.coalesce(fold("doc_id", 5) != 1, F.lit(False)))
    small_batches(spark)
    with passing(spark):
        automaton = build(checkpoint(gram_counts(docs.where("in_training"))))
    scored = score_texts(docs, automaton, "in_training")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
