"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its UTF-8 bytes and one end mark.  Each byte is eight binary decisions, most
significant bit first; the node of a decision is the bits of the byte so far together with
the last j bytes, for every depth j from 0 to ``DEPTH``.  A node estimates its decision by
Krichevsky-Trofimov counts, and every node mixes its own estimate with that of the deeper
contexts by the weighted sequence probabilities of the learning texts.  A context that was
never met in learning ends the path: the deepest node that was met speaks for it.

The work, all of it over the whole table:

1. one pass counts the (context, byte) strings of the texts, each task combining its own;
2. counts are dealt by the last two context bytes, so all deeper nodes of a path meet in one
   task, which sums the weighted probabilities from the leaves up to depth 2; the 256 x 255
   nodes of depth 1 and those of depth 0 are finished from one more aggregation;
3. the same tasks walk down again and give each string of the corpus its log probability;
4. a second pass over the texts adds these up.  The most frequent strings (a fixed number) are
   sent to the executors; the others go by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import list_of, stage
from repochron.llm.lookup import Lookup
from repochron.llm.words import LOWER, NOT_SPACE, Run, runs, split_words

DEPTH = 5
END = 0xFF  # no byte of UTF-8
#: entries of a table that is sent to the executors
SENT_STRINGS, SENT_WORDS = 1 << 21, 1 << 20
#: distinct keys that a task holds before it passes its counts on
HELD_KEYS = 1 << 21


def strings_of(run: Run, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts): for every byte and end mark, the ``depth`` bytes before it (zero ahead of the text) and itself."""
    n, lengths = len(run.bounds) - 1, np.diff(run.bounds)
    starts = run.bounds[:-1] + np.arange(n) * (depth + 1) + depth
    padded = np.zeros(len(run.data) + n * (depth + 1), np.uint8)
    padded[np.arange(len(run.data)) + np.repeat(starts - run.bounds[:-1], lengths)] = run.data
    padded[starts + lengths] = END
    keys = np.zeros(len(padded) - depth if n else 0, np.uint64)
    for j in range(depth + 1):
        keys |= padded[j:len(padded) - depth + j].astype(np.uint64) << np.uint64(8 * (depth - j))
    real = np.ones(len(padded), bool)
    real[(starts[:, None] - 1 - np.arange(depth)).ravel()] = False
    return keys[real[depth:]], np.repeat(np.arange(n), lengths + 1)


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series after eight steps of the recurrence."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1) - np.log(np.pi)


def _nodes(keys: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, decision) of one bit of each string: the context with the byte replaced by its bits so far."""
    byte = keys & np.uint64(255)
    so_far = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
    return (keys & ~np.uint64(255)) | so_far, (byte >> np.uint64(7 - bit)) & np.uint64(1)


def _shorter(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The node of the last ``depth`` context bytes."""
    return nodes & np.uint64((1 << (8 * (depth + 1))) - 1)


class Level:
    """Nodes of one depth with counts and the ln of their weighted probability."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.nodes, where = np.unique(nodes, return_inverse=True)
        add = lambda v: np.bincount(where, v, len(self.nodes))
        self.zeros, self.ones = add(zeros), add(ones)
        own = ln_kt(self.zeros, self.ones)
        if below is None:
            self.weighted, self.share = own, np.ones(len(own))
        else:
            deeper = add(below)
            self.weighted = np.logaddexp(own, deeper) - np.log(2)
            self.share = 1 / (1 + np.exp(np.minimum(deeper - own, 700)))
        self.estimate = (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def descend(self, done: np.ndarray, rest: np.ndarray) -> None:
        """Takes what the shallower nodes have mixed and left, for each node."""
        self.speaks = done + rest * self.estimate
        self.done, self.rest = done + rest * self.share * self.estimate, rest * (1 - self.share)


def levels_of(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels ``depth`` down to ``least`` of the strings with their learning counts."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen].astype(float)
    parts = [_nodes(keys, bit) for bit in range(8)]
    nodes, ones = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) == 1
    weight = np.tile(counts, 8)
    out = [Level(nodes, weight * ~ones, weight * ones, None)]
    for d in range(depth - 1, least - 1, -1):
        up = out[-1]
        out.append(Level(_shorter(up.nodes, d), up.zeros, up.ones, up.weighted))
    return out


def ln_strings(keys: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """ln probability of the last byte of each string; ``levels`` deepest first, down to depth 0, all descended."""
    total = np.zeros(len(keys))
    for bit in range(8):
        nodes, one = _nodes(keys, bit)
        p, open_ = np.full(len(keys), 0.5), np.arange(len(keys))
        for k, level in enumerate(levels):
            if not len(open_) or not len(level.nodes):
                continue
            wanted = _shorter(nodes[open_], depth - k)
            at = np.minimum(np.searchsorted(level.nodes, wanted), len(level.nodes) - 1)
            met = level.nodes[at] == wanted
            p[open_[met]] = level.speaks[at[met]]
            open_ = open_[~met]
        total += np.log(np.where(one == 1, p, 1 - p))
    return total


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def string_table(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, value): log10 probability of each string of (key, learned, n)."""
    spark = counts.sparkSession
    dealt = counts.withColumn("_deal", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))).repartition("_deal").drop("_deal")

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, learned = _partition(batches)
        top = levels_of(keys, learned, depth, 2)[-1] if (learned > 0).any() else None
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array(_shorter(top.nodes, 1).view(np.int64)), pa.array(top.zeros), pa.array(top.ones), pa.array(top.weighted)], ["node", "zeros", "ones", "weighted"])

    shallow = dealt.select("key", "learned").mapInArrow(upward, "node bigint, zeros double, ones double, weighted double")
    # at most 256 contexts x 255 nodes
    got = shallow.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).orderBy("node").toArrow()
    nodes = got["node"].to_numpy().view(np.uint64)
    first = Level(nodes, got["zeros"].to_numpy(), got["ones"].to_numpy(), got["weighted"].to_numpy())
    root = Level(_shorter(first.nodes, 0), first.zeros, first.ones, first.weighted)
    root.descend(np.zeros(len(root.nodes)), np.ones(len(root.nodes)))
    above = np.searchsorted(root.nodes, _shorter(first.nodes, 0))
    first.descend(root.done[above], root.rest[above])
    sent = spark.sparkContext.broadcast((first, root))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        keys, learned = _partition(held)
        if not len(keys):
            return
        first, root = sent.value
        levels = [*levels_of(keys, learned, depth, 2), first, root] if (learned > 0).any() else [first, root]
        for k in range(len(levels) - 3, -1, -1):
            above = np.searchsorted(levels[k + 1].nodes, _shorter(levels[k].nodes, depth - k - 1))
            levels[k].descend(levels[k + 1].done[above], levels[k + 1].rest[above])
        value = np.full(len(keys), 8 * np.log(0.5)) if not len(root.nodes) else ln_strings(keys, levels, depth) if len(levels) > 2 else ln_strings(keys, levels, 1)
        n = np.concatenate([b.column(2).to_numpy() for b in held])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(value / np.log(10))], ["key", "n", "value"])

    return dealt.select("key", "learned", "n").mapInArrow(downward, "key bigint, n bigint, value double")


class Held:
    """Counts of keys that a task gathers; passed on as rows when there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        unique, where, n = np.unique(keys, return_inverse=True, return_counts=True)
        self.parts.append((unique, np.bincount(where, learned, len(unique)).astype(np.int64), n))
        self.size += len(unique)
        if self.size > HELD_KEYS and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            unique, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            self.parts = [(unique, *[np.bincount(where, np.concatenate([p[i] for p in self.parts]), len(unique)).astype(np.int64) for i in (1, 2)])]
            self.size = len(unique)

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, learned, n in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(learned), pa.array(n.astype(np.int64))], ["kind", "key", "learned", "n"])
        self.parts, self.size = [], 0


def corpus_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, learned, n): strings (kind 0) and words (kind 1) of all texts, and of the learning ones."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(), Held()
        for batch in batches:
            learn = ~batch.column(1).to_numpy(zero_copy_only=False)
            for run in runs(batch.column(0)):
                mine = learn[run.rows].astype(float)
                keys, text = strings_of(run, depth)
                held[0].add(keys, mine[text])
                words = split_words(run, NOT_SPACE, LOWER)
                held[1].add(words.hash, mine[words.text])
                for kind, h in enumerate(held):
                    if h.size > HELD_KEYS:
                        yield from h.rows(kind)
        for kind, h in enumerate(held):
            yield from h.rows(kind)

    rows = texts.select("_text", "_held").mapInArrow(over, "kind int, key bigint, learned bigint, n bigint")
    return rows.groupBy("kind", "key").agg(F.sum("learned").alias("learned"), F.sum("n").alias("n"))


def most_frequent(table: DataFrame, limit: int) -> tuple[Lookup, Column]:
    """The keys of the most frequent classes (by powers of two of n), at most ``limit``, and the condition of the rest."""
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")
    least = 64
    left = limit
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if row["count"] > left:
            break
        least, left = row["level"], left - row["count"]
    got = table.filter(level >= least).select("key", "value").toArrow()
    return Lookup(got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()), level < least


def held_out(id_: Column, of: int = 7, rest: int = 2) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def score_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    One row for each row of ``docs``; a null text is an empty one, whose score is that of the end
    mark and whose base has one token.  Repeated rows are counted as often as they stand and
    score alike.  If nothing is learned, every byte and end mark costs eight bits.  An empty
    table gives an empty result.  Words are told apart by 64-bit hashes.  Columns other than id
    and text are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_h"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"), held_out(F.col(id_column)).alias("_held"))
    counts = stage(corpus_counts(texts, depth))
    strings = stage(string_table(counts.filter("kind = 0").select("key", "learned", "n"), depth))
    words = counts.filter("kind = 1 AND learned > 0").select("key", F.col("learned").alias("n"), F.log10(F.col("learned") + 1).alias("value"))
    n_words, n_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_texts = texts.filter("not _held").count()
    train_tokens, distinct = n_tokens + n_texts, n_words + (n_texts > 0)
    (string_lookup, rare_string), (word_lookup, rare_word) = most_frequent(strings, SENT_STRINGS), most_frequent(words, SENT_WORDS)
    sent = spark.sparkContext.broadcast((string_lookup, word_lookup))
    kind_id = texts.schema["_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(2)):
                n = len(run.bounds) - 1
                rest_text, rest_kind, rest_key = [], [], []
                sums = []
                words = split_words(run, NOT_SPACE, LOWER)
                for kind, (lookup, (keys, text)) in enumerate(zip(sent.value, (strings_of(run, depth), (words.hash, words.text)), strict=True)):
                    at = lookup.find(keys)
                    met = at >= 0
                    sums.append(np.bincount(text[met], lookup.values[at[met]], n) if met.any() else np.zeros(n))
                    sums.append(np.bincount(text[met], minlength=n))
                    rest_text.append(text[~met]), rest_kind.append(np.full(int((~met).sum()), kind, np.int32)), rest_key.append(keys[~met])
                text = np.concatenate(rest_text)
                order = np.argsort(text, kind="stable")
                rest = pa.StructArray.from_arrays([pa.array(np.concatenate(rest_kind)[order]), pa.array(np.concatenate(rest_key)[order].view(np.int64))], ["kind", "key"])
                rows = batch.slice(run.rows.start, n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(3), pa.array(words.counts.astype(np.int64)), pa.array(np.diff(run.bounds).astype(np.int64)),
                     pa.array(sums[0].astype(float)), pa.array(sums[2].astype(float)), pa.array(sums[3].astype(np.int64)), list_of(np.bincount(text, minlength=n), rest)],
                    ["_id", "_h", "held_out", "words", "n_bytes", "string_sum", "word_sum", "known", "rest"])

    scored = stage(texts.select("_id", "_h", "_text", "_held").mapInArrow(
        over, f"_id {kind_id}, _h bigint, held_out boolean, words bigint, n_bytes bigint, string_sum double, word_sum double, known bigint, rest array<struct<kind: int, key: bigint>>"))
    pairs = scored.filter("size(rest) > 0").select("_id", "_h", F.explode("rest").alias("r")).select("_id", "_h", "r.kind", "r.key").groupBy("_id", "_h", "kind", "key").agg(F.count("*").alias("m"))
    rare = strings.filter(rare_string).select(F.lit(0).alias("kind"), "key", "value").unionByName(words.filter(rare_word).select(F.lit(1).alias("kind"), "key", "value"))
    part = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    more = pairs.join(rare, ["kind", "key"]).groupBy("_id", "_h").agg(
        part(0, F.col("m") * F.col("value")).alias("strings"), part(1, F.col("m") * F.col("value")).alias("words"), part(1, F.col("m")).alias("known"))
    # repeated rows have one key here, and their rest was added up
    more = more.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), F.col("strings").alias("_strings"), F.col("words").alias("_words"), F.col("known").alias("_known"))
    copies = scored.groupBy(F.col("_id").alias("_j"), F.col("_h").alias("_k")).agg(F.count("*").alias("_copies"))
    more = more.join(copies, F.col("_i").eqNullSafe(F.col("_j")) & (F.col("_g") == F.col("_k")))
    all_ = scored.join(more, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    extra = lambda c: F.coalesce(F.col(c) / F.col("_copies"), F.lit(0.0))
    tokens = F.col("words") + 1
    score = F.col("string_sum") + extra("_strings")
    return all_.select(
        F.col("_id").alias(id_column), "held_out", tokens.alias("n_tokens"),
        (F.col("known") + F.round(extra("_known")).cast("long") + F.lit(int(n_texts > 0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("word_sum") + extra("_words") + F.log10(F.lit(n_texts + 1.0)) - tokens * F.log10(F.lit(float(train_tokens + distinct + 1)))).alias("base_score"),
        score.alias("score"), "n_bytes", (-score / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
