"""Toxicity by two class-conditional Kneser-Ney models of how words go on.

A word is predicted from its beginning: after its first 0, 1, ... bytes the next longer
beginning, and at last the whole word.  Each class has its own counts of these steps.  They are
Kneser-Ney counts: not occurrences, but distinct words before the word, so a repeated or copied
passage counts once.  Every count gives up a discount (``DISCOUNT`` and one standard deviation),
and what a class gave up at a beginning comes back as the continuation counts of both classes
together: a rare expression is judged by what both have seen, and alike in both, while an
unseen ending still shows the beginning it shares with others.

A text is read in two ways.  The ordinary reading takes the ordinary model for all words.  The
toxic reading may take the toxic model for a word, at a cost of ``SWITCH`` nats.  The gain of the
toxic reading in log-likelihood, divided by the number of words, is compared over runs of ``RUN``
consecutive words (a shorter text is one run), so that a long text hides nothing; the greatest is
the statistic of the text, and a logistic curve fitted on labelled rows that were not counted
makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.llm.common import list_of, map_batches, stage
from repochron.llm.lookup import Lookup
from repochron.llm.words import ALNUM, LOWER, Run, Words, mixed, runs, split_words

#: labelled rows of each class that a fit sees, the first in hash order of their id, and their bytes
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
#: one of so many sample rows fits the curve, the others are counted
CURVE_PART = 5
#: steps that a model keeps at most, those with the most evidence
MODEL_STEPS = 1 << 21
#: bytes of the longest beginning below the whole word
LONGEST = 6
DISCOUNT = 0.75
SWITCH = 1.0
RUN = 64
THRESHOLD = 0.3


def ladders(run: Run) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, kinds, steps): the words of a run, the distinct word each is, and the step keys of the distinct words.

    ``steps[k]`` is the key of the beginning of k + 1 bytes, the last row that of the whole word.
    """
    words = split_words(run, ALNUM, LOWER)
    _, first, kinds = np.unique(words.hash, return_index=True, return_inverse=True)
    prefix = run.prefix_hash(LOWER)
    start, end = words.start[first], words.end[first]
    steps = [mixed(run.span_hash(prefix, start, np.minimum(end, start + k)) + np.uint64(k)) for k in range(1, LONGEST + 1)]
    return words, kinds, np.stack([*steps, words.hash[first]])


def neighbours(sample: DataFrame) -> DataFrame:
    """(toxic, pair, word) of (_label, _text): each word with a hash of itself and the word before it, once for each text run."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = batch.column(0).to_numpy()
        for run in runs(batch.column(1)):
            words = split_words(run, ALNUM, LOWER)
            before = np.zeros(len(words.hash), np.uint64)
            before[1:] = words.hash[:-1]
            before[words.first[:-1][words.counts > 0]] = 0
            toxic = label[run.rows][words.text].astype(np.uint64)
            pair = mixed(before * np.uint64(3) + words.hash)
            _, at = np.unique(pair * np.uint64(2) + toxic, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic[at].astype(np.int32)), pa.array(pair[at].view(np.int64)), pa.array(words.hash[at].view(np.int64))], ["toxic", "pair", "word"])

    return map_batches(sample.select("_label", "_text"), over, "toxic int, pair bigint, word bigint").distinct()


def spellings(sample: DataFrame) -> DataFrame:
    """(word, steps): the step keys of every distinct word."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(0)):
            _, _, steps = ladders(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(steps[-1].view(np.int64)), list_of(np.full(steps.shape[1], len(steps)), np.ascontiguousarray(steps.T).ravel().view(np.int64))], ["word", "steps"])

    return map_batches(sample.select("_text"), over, "word bigint, steps array<bigint>").groupBy("word").agg(F.min("steps").alias("steps"))


def step_ratios(sample: DataFrame) -> DataFrame:
    """(key, ratio, evidence): ln of the toxic over the ordinary probability of each step, from (_label, _text)."""
    counted = neighbours(sample).groupBy("word").agg(*[F.sum((F.col("toxic") == c).cast("double")).alias(f"n{c}") for c in (0, 1)])
    step = F.explode(F.transform("steps", lambda key, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.element_at("steps", F.greatest(i, F.lit(1)))).alias("after"), key.alias("key"))))
    steps = counted.join(spellings(sample), "word").select(step.alias("s"), "n0", "n1").groupBy("s.after", "s.key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    steps = stage(steps)
    given = lambda n: F.least(F.col(n), F.lit(DISCOUNT) + F.sqrt(n))
    beginnings = steps.groupBy("after").agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)], *[F.sum(given(f"n{c}")).alias(f"g{c}") for c in (0, 1)])
    shared = (F.col("n0") + F.col("n1")) / (F.col("t0") + F.col("t1"))
    chance = lambda c: (F.col(f"n{c}") - given(f"n{c}") + F.col(f"g{c}") * shared) / F.col(f"t{c}")
    # a beginning that one class never met says nothing about its endings
    ratios = steps.join(beginnings, "after").filter("t0 > 0 AND t1 > 0").select("key", F.ln(chance(1) / chance(0)).alias("ratio"), (F.col("n0") + F.col("n1")).alias("n"))
    return ratios.select("key", "ratio", (F.abs("ratio") * F.col("n")).alias("evidence")).filter("ratio <> 0")


@dataclass
class Model:
    """Step ratios, and the curve from a text's statistic to its score."""

    steps: Lookup
    slope: float = 0.0
    level: float = 0.0

    def gains(self, run: Run) -> tuple[Words, np.ndarray]:
        """The words of a run and what the toxic reading gains by each."""
        words, kinds, steps = ladders(run)
        ratio = np.zeros(steps.shape[1])
        for keys in steps if len(self.steps.keys) else ():
            at = self.steps.find(keys)
            ratio += np.where(at >= 0, self.steps.values[np.maximum(at, 0)], 0.0)
        return words, np.maximum(ratio - SWITCH, 0)[kinds]

    def statistic(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """(words, greatest gain a word over any run of ``RUN`` words) of each text."""
        words, gain = self.gains(run)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        last = words.first[1:][words.text]
        sums = total[np.minimum(np.arange(len(gain)) + RUN, last)] - total[:-1]
        out = np.zeros(len(words.counts))
        full = np.flatnonzero(words.counts)
        if len(full):
            out[full] = np.maximum.reduceat(sums, words.first[:-1][full]) / np.minimum(words.counts[full], RUN)
        return words.counts, out

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * statistic + self.level, -60, 60)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and level of a weighted logistic curve, by Newton steps with a small penalty on the slope.

    Without rows of both classes the curve is flat at their smoothed share.
    """
    share = (weight @ y + 1) / (weight.sum() + 2)
    level = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return 0.0, level
    scale = x.std() + 1e-9
    z = np.stack([x / scale, np.ones(len(x))], 1)
    penalty = np.diag([0.05, 1e-6])
    w = np.array([0.0, level])
    loss = lambda w: weight @ np.logaddexp(0, -(2 * y - 1) * (z @ w)) + w @ penalty @ w / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (0.0, level)


def held_out(id_: Column, of: int = 4, rest: int = 2) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_column: str, text_column: str, label: str, rows: int, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(_label, _text, _curve) of at most ``rows`` rows and ``size`` bytes of each class, and how many labelled ids each class has.

    Both bounds take rows in hash order of their id (the first row is taken whatever its size).  An
    id with labels of both classes is toxic; of several texts of one id the one of least hash is taken.
    """
    marked = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).dropna().filter("_label in (0, 1)").filter(~held_out(F.col("_id")))
    marked = stage(marked.groupBy("_id").agg(F.max("_label").alias("_label")))
    totals = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id")
    chosen = [marked.filter(F.col("_label") == c).orderBy(order, "_id").limit(rows) for c in (0, 1)]
    # at most 2 * rows ids
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).join(F.broadcast(chosen[0].union(chosen[1])), "_id")
    texts = stage(texts.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t")).select("_id", "_label", order.alias("_order"), F.col("t._text").alias("_text")))
    sizes = texts.select("_id", "_label", "_order", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("b"))
    # a running sum over at most ``rows`` rows of a class
    before = F.sum("b").over(Window.partitionBy("_label").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + F.col("b") <= size)).select("_id")
    sample = texts.join(F.broadcast(kept), "_id").select("_label", "_text", (F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(CURVE_PART)) == 0).alias("_curve"))
    return stage(sample), totals


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled rows that are not held out."""
    sample, totals = labelled_sample(docs, labels, id_column=id_column, text_column=text_column, label=label, rows=rows, size=size)
    got = step_ratios(sample.filter("not _curve")).orderBy(F.desc("evidence"), "key").limit(MODEL_STEPS).select("key", F.col("ratio").cast("float").alias("ratio")).toArrow()
    model = Model(Lookup(got["key"].to_numpy().view(np.uint64), got["ratio"].to_numpy()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([sent.value.statistic(run)[1] for run in runs(batch.column(1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["y", "x"])

    # at most 2 * rows rows of two numbers
    seen = map_batches(sample.filter("_curve").select("_label", "_text"), over, "y int, x double").orderBy("y", "x").toArrow()
    y, x = seen["y"].to_numpy().astype(float), seen["x"].to_numpy()
    # each class weighs as much as it does among all labelled rows
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = totals[c] / (y == c).sum()
    model.slope, model.level = fit_curve(x, y, weight * len(y) / max(weight.sum(), 1))
    sent.unpersist()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, n_words, gain): the probability of label 1, and whether it is ``threshold`` or more.

    One row for each row of ``docs``.  gain is the text's statistic: the greatest gain a word of the
    toxic reading over any ``RUN`` words.  A null or empty text, or one without words, gains nothing
    and has the score of such a text.  Repeated rows score alike.  Without labels of both classes
    all rows score alike: their smoothed share, one half without any.  An empty table gives an empty
    result.  Labels other than 0 and 1 are not learned.  Columns other than id and text are not
    looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_column=id_column, text_column=text_column, label=label, rows=rows, size=size))
    source = docs.select(F.col(id_column).alias("_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [model.value.statistic(run) for run in runs(batch.column(2))]
        words, gain = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        score = model.value.score(gain)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(words.astype(np.int64)), pa.array(gain)], ["_id", "held_out", "score", "predicted", "n_words", "gain"])

    found = map_batches(source, over, f"_id {kind}, held_out boolean, score double, predicted int, n_words bigint, gain double")
    return found.select(F.col("_id").alias(id_column), "held_out", "score", "predicted", "n_words", "gain")
