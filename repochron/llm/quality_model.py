"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word is three tokens: itself, its first letters, and its written shape.  A token has a
sparse random index vector; its context vector is the sum of the index vectors next to it
over the whole corpus (one pass, one partial sum a task).  Tokens share ``TOKENS`` slots by
hash, so the table has a fixed size.  A document is the mean of its tokens' vectors.  Labels
are learned by a two-layer numpy network from a bounded sample, whose logits are divided by a
temperature fitted on the part of the sample that the network did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import list_of, stage
from repochron.llm.words import LOWER, NOT_SPACE, Run, Words, runs, split_words

TOKENS = (1 << 14, 1 << 13, 1 << 10)  # slots of words, beginnings, shapes
WIDTH = 32
NONZERO = 2  # entries of an index vector
#: bytes of texts that a task scores at once
CHUNK = 1 << 18
#: labelled rows that the network is fitted on, the first in hash order of their id
SAMPLE_ROWS = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.005, 1e-4
SEED = 20

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LAST = np.zeros(256, np.int64)  # class of a word's last byte
for _i, _c in enumerate((".,;:", "!?", "#", "$", "%", "&", "*", "|<>", "\"')]}")):
    _LAST[[ord(c) for c in _c]] = _i + 1


def index_vectors(slots: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of each slot's index vector."""
    rng = np.random.default_rng(SEED + stream)
    return rng.integers(0, WIDTH, (slots, NONZERO)), rng.choice([-1.0, 1.0], (slots, NONZERO))


def tokens_of(run: Run) -> tuple[Words, list[np.ndarray]]:
    """The words of a run and the slot of each word in the three streams."""
    words = split_words(run, NOT_SPACE, LOWER)
    begin = run.span_hash(run.prefix_hash(LOWER), words.start, np.minimum(words.end, words.start + 4))
    within = lambda table: np.concatenate([[0], np.cumsum(table[run.data])])
    capitals, digits = within(_UPPER), within(_DIGIT)
    length = words.end - words.start
    upper = capitals[words.end] - capitals[words.start]
    again = np.zeros(len(length), np.int64)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    shape = np.minimum(upper, 2)
    shape = shape * 2 + (digits[words.end] > digits[words.start])
    shape = shape * 10 + (_LAST[run.data[words.end - 1]] if len(length) else 0)
    shape = shape * 4 + np.searchsorted([2, 6, 12], length)
    shape = shape * 2 + again
    slot = lambda h, n: (h & np.uint64(n - 1)).astype(np.int64)
    return words, [slot(words.hash, TOKENS[0]), slot(begin, TOKENS[1]), shape.astype(np.int64)]


def context_sums(docs: DataFrame, text_column: str) -> DataFrame:
    """(stream, slot, v0, v1, ...): context vectors over all documents."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [index_vectors(n, i) for i, n in enumerate(TOKENS)]
        sums = [np.zeros(n * WIDTH) for n in TOKENS]
        for batch in batches:
            for run in runs(batch.column(0), CHUNK):
                words, slots = tokens_of(run)
                pair = np.flatnonzero(words.text[1:] == words.text[:-1])
                for slot, (places, signs), total in zip(slots, index, sums, strict=True):
                    for own, other in ((slot[pair], slot[pair + 1]), (slot[pair + 1], slot[pair])):
                        for j in range(NONZERO):
                            total += np.bincount(own * WIDTH + places[other, j], signs[other, j], len(total))
        for stream, total in enumerate(sums):
            table = total.reshape(-1, WIDTH)
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), stream, np.int32)), pa.array(used.astype(np.int32)), *[pa.array(table[used, i]) for i in range(WIDTH)]], ["stream", "slot", *[f"v{i}" for i in range(WIDTH)]])

    columns = [f"v{i}" for i in range(WIDTH)]
    rows = docs.select(F.col(text_column).cast("string")).mapInArrow(over, "stream int, slot int, " + ", ".join(f"{c} double" for c in columns))
    return rows.groupBy("stream", "slot").agg(*[F.sum(c).alias(c) for c in columns])


def word_vectors(docs: DataFrame, text_column: str = "text") -> list[np.ndarray]:
    """A table of unit context vectors plus index vectors for each stream; of fixed size."""
    got = context_sums(docs, text_column).orderBy("stream", "slot").toArrow()
    stream, slot = got["stream"].to_numpy(), got["slot"].to_numpy()
    values = np.stack([got[f"v{i}"].to_numpy() for i in range(WIDTH)], 1) if len(stream) else np.zeros((0, WIDTH))
    out = []
    for i, n in enumerate(TOKENS):
        places, signs = index_vectors(n, i)
        table = np.zeros((n, WIDTH))
        np.add.at(table, (np.arange(n)[:, None], places), signs / np.sqrt(NONZERO))
        mine = stream == i
        norm = np.linalg.norm(values[mine], axis=1, keepdims=True)
        table[slot[mine]] += values[mine] / np.maximum(norm, 1e-9)
        out.append(table.astype(np.float32))
    return out


def pooled(run: Run, tables: list[np.ndarray]) -> np.ndarray:
    """Mean vectors of the texts of a run, streams side by side, and the log of the word count."""
    words, slots = tokens_of(run)
    n, counts = len(run.bounds) - 1, words.counts
    out = np.zeros((n, len(tables) * WIDTH + 1), np.float32)
    full = np.flatnonzero(counts)
    for i, (slot, table) in enumerate(zip(slots, tables, strict=True)):
        if len(full):
            out[full, i * WIDTH:(i + 1) * WIDTH] = np.add.reduceat(table[slot], words.first[:-1][full], axis=0, dtype=np.float32) / counts[full, None]
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature from the last fifth.

    Labels of one kind, or none, give a network whose score is their smoothed share.
    """
    rng = np.random.default_rng(SEED)
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return net
    net.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    train, check = order[:cut], order[cut:]
    z, target = (x - mean) / scale, y.astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            a = z[rows] @ params[0] + params[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            d = (p - target[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (a > 0)
            grads = [z[rows].T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(check):
        logits, truth = net.logits(x[check]), target[check]
        loss = lambda k: np.mean(np.logaddexp(0, -(2 * truth - 1) * logits / k))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(id_: Column, of: int = 3, rest: int = 1) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], Network]:
    """Word vectors of all documents, and the network fitted on labelled rows that are not held out.

    The network sees ``sample`` labelled rows at most, the first in hash order of their id.
    """
    tables = word_vectors(docs, text_column)
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    marked = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).dropna().filter(~held_out(F.col("_id"))).dropDuplicates(["_id"])
    # at most ``sample`` rows of two numbers
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).join(chosen, "_id").select("_id", "_label", "_text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(2), CHUNK):
                x = pooled(run, sent.value)
                part = batch.slice(run.rows.start, len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), list_of(np.full(len(x), x.shape[1]), x.ravel())], ["_id", "_label", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = stage(rows.mapInArrow(over, f"_id {kind}, _label int, x array<float>")).dropDuplicates(["_id"]).orderBy("_id").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, len(TOKENS) * WIDTH + 1))
    return tables, fit_network(x.astype(float), got["_label"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with (held_out, score, predicted): the probability of label 1, and whether it is 0.5 or more.

    A null text is an empty one; it is scored too.  Repeated rows score alike.  Without labels all
    rows score one half.  An empty table gives an empty result.  Only the text enters a score.
    Columns of ``docs`` with a result's name are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_column=id_column, text_column=text_column, label=label, sample=sample))

    # only texts go to Python and only scores come back
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        tables, net = model.value
        return pa.array(np.concatenate([np.zeros(0), *[net.score(pooled(run, tables)) for run in runs(texts, CHUNK)]]))

    scored = docs.select("*", held_out(F.col(id_column)).alias("held_out"), score(F.col(text_column).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
