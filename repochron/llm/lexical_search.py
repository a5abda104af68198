"""Ranked lexical search over K2-treaps of the term-document grid.

The grid has a row for each query term, a column for each document, and in a cell the impact of
the term in the document: what the term, asked for once, adds to the document's score.  A block
of documents is one K2-treap: a quadtree that keeps only quarters with a non-empty cell, and in
every node the greatest impact below it.  Nodes lie in arrays, level by level; a node has a mask
of its quarters and the number of its first child, so a child is found by counting mask bits.

An item follows the paths of its term rows together.  A state is a range of documents with one
node for each term; the sum of their maxima, times how often the item has each term, bounds the
score of every document in the range.  The states with the greatest bounds are opened first, a
batch at a time, each into the two halves of its range; a range of one document has its exact
score.  A state is dropped when its bound is below the k-th score found, or equal to it where all
its documents come later.

The documents are read once, into a table of the query terms that each holds; the counts that
impacts need are aggregates of that table.  Each task then builds and searches the blocks of its
part, and the best of the blocks are merged by windows, in two rounds for items of many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron.llm.common import list_of, map_batches, stage
from repochron.llm.lookup import Lookup
from repochron.llm.words import ALNUM, LOWER, runs, split_words

TOP = 20
#: non-empty cells and documents of a block
BLOCK_CELLS, BLOCK_DOCUMENTS = 1 << 19, 1 << 14
#: distinct terms of the items that are searched for together; more items take more rounds
ROUND_TERMS = 1 << 18
#: states times terms that are opened together
BATCH = 1 << 12
#: parts that the results of an item are merged in first
MERGE_PARTS = 64


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers, moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


#: how many quarters of a mask lie before each quarter
_BEFORE = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)], np.int64)


class Treap:
    """K2-treap of the cells (row, column, value > 0) of a square grid of 2**height rows; no cell twice.

    The last node is an empty one without children, which stands for every quarter that is left out.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int):
        self.height = height
        code = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(code)
        code, best = code[order], values[order]
        levels = [(best, np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64))]
        for _ in range(height):
            up = code >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            mask = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first)
            best = np.maximum.reduceat(best, first)
            levels.append((best, mask, first))
            code = up[first]
        levels.reverse()
        sizes = np.array([len(level[0]) for level in levels])
        offsets = np.concatenate([np.cumsum(sizes)[:-1], [0]])  # where the children of a level begin
        self.best = np.concatenate([*[level[0] for level in levels], [0]])
        self.mask = np.concatenate([*[level[1] for level in levels], np.zeros(1, np.uint8)])
        self.child = np.concatenate([*[level[2] + offset for level, offset in zip(levels, offsets, strict=True)], [0]])

    def children(self, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """A quarter of each node, or the empty node."""
        mask = self.mask[nodes]
        return np.where(mask >> quarter & 1, self.child[nodes] + _BEFORE[mask, quarter], len(self.best) - 1)

    def search(self, rows: np.ndarray, times: np.ndarray, k: int, least: int, first_rank: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the ``k`` best columns, equal scores by rank; scores below ``least`` may be left out.

        A score is the sum of the values in ``rows``, each taken ``times``.  ``first_rank`` has the
        least rank of each range, level by level.
        """
        at_once = max(1, BATCH // max(1, len(rows)))
        column, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, place, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([self.best[0] * times.sum()])
        nodes = np.zeros((1, len(rows)), np.int64)
        while len(bound):
            if len(bound) > at_once:
                split = np.argpartition(-bound, at_once - 1)
                now, later = split[:at_once], split[at_once:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            side = (rows >> (self.height - 1 - level[now])[:, None]) & 1
            below = [self.children(nodes[now], (side * 2 + half).astype(np.uint8)) for half in (0, 1)]
            new_nodes = np.concatenate(below)
            new_level = np.tile(level[now] + 1, 2)
            new_place = np.concatenate([place[now] * 2, place[now] * 2 + 1])
            new_bound = self.best[new_nodes] @ times
            done = (new_level == self.height) & (new_bound > 0)
            if done.any():
                column, score = np.concatenate([column, new_place[done]]), np.concatenate([score, new_bound[done]])
                order = np.lexsort((rank[column], -score))[:k]
                column, score = column[order], score[order]
            kth, its_rank = (score[-1], rank[column[-1]]) if len(score) == k else (0, 0)
            if kth < least:
                kth, its_rank = least, np.iinfo(np.int64).max
            fresh = np.flatnonzero((new_level < self.height) & (new_bound > 0) & (new_bound >= kth))
            level, place, bound = np.concatenate([level[later], new_level[fresh]]), np.concatenate([place[later], new_place[fresh]]), np.concatenate([bound[later], new_bound[fresh]])
            nodes = np.concatenate([nodes[later], new_nodes[fresh]])
            keep = (bound > kth) | (first_rank[(1 << level) - 1 + place] <= its_rank)
            if not keep.all():
                level, place, bound, nodes = level[keep], place[keep], bound[keep], nodes[keep]
        return column, score


@dataclass
class Queries:
    """Items of one round: the distinct terms, and each item's terms (as numbers of ``terms``) with how often it has them."""

    terms: np.ndarray
    of: list[np.ndarray]
    times: list[np.ndarray]


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, item_id, terms, times): the distinct terms of every item, by hash; one row for items of one id and text."""
    source = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("_text")).distinct()
    source = source.select("item_id", F.xxhash64("item_id", "_text", F.isnull("item_id"), F.isnull("_text")).alias("item"), "_text")
    kind = source.schema["item_id"].dataType.simpleString()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(2)):
            words = split_words(run, ALNUM, LOWER)
            parts = [np.unique(words.hash[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            sizes = np.array([len(p[0]) for p in parts])
            rows = batch.slice(run.rows.start, len(parts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *[list_of(sizes, np.concatenate([p[i] for p in parts]).view(np.int64)) for i in (0, 1)]], ["item_id", "item", "terms", "times"])

    return map_batches(source, over, f"item_id {kind}, item bigint, terms array<bigint>, times array<bigint>")


def forward_index(docs: DataFrame, vocabulary, id_column: str, text_column: str) -> DataFrame:
    """(_id, n, terms, times): the number of terms of every document, and those in the vocabulary (by number) with how often."""
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(1)):
            words = split_words(run, ALNUM, LOWER)
            term = vocabulary.value.find(words.hash)
            met = term >= 0
            size = max(1, len(vocabulary.value.keys))
            cell, times = np.unique(words.text[met] * size + term[met], return_counts=True)
            n = len(words.counts)
            sizes = np.bincount(cell // size, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(run.rows.start, n), pa.array(words.counts.astype(np.int64)), list_of(sizes, (cell % size).astype(np.int32)), list_of(sizes, times.astype(np.int64))], ["_id", "n", "terms", "times"])

    return map_batches(source, over, f"_id {kind}, n bigint, terms array<int>, times array<bigint>")


def impacts(times: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """weight * (10**9 times div (1000 times + 12 m)) with m = 75 + 25 n N div L, in whole numbers."""
    if int(n.max(initial=0)) * documents * 25 < 1 << 63:
        m = 75 + 25 * n * documents // max(length, 1)
    else:
        m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
    return weight * (10**9 * times // (1000 * times + 12 * m))


def _search_block(parts: list[pa.RecordBatch], queries: Queries, weights: np.ndarray, documents: int, length: int, k: int, least: np.ndarray) -> pa.RecordBatch | None:
    """The best rows of a block for each item; ``least`` has the k-th score of each item in earlier blocks and is raised."""
    ids = pa.concat_arrays([p.column(0) for p in parts])
    n = np.concatenate([p.column(1).to_numpy() for p in parts])
    sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
    term = np.concatenate([p.column(2).flatten().to_numpy() for p in parts]).astype(np.int64)
    times = np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
    owner = np.repeat(np.arange(len(n)), sizes)
    value = impacts(times, n[owner], weights[term], documents, length)
    keep = value > 0
    owner, term, value, times = owner[keep], term[keep], value[keep], times[keep]
    if not len(value):
        return None
    rank = np.empty(len(n), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))
    # documents of one language and size stand together: the most common term of each, then its length
    df = np.bincount(term, minlength=len(weights))
    used = np.flatnonzero(df)
    row_of = np.zeros(len(weights), np.int64)
    row_of[used[np.argsort(df[used], kind="stable")]] = np.arange(len(used))
    common = np.full(len(n), -1)
    np.maximum.at(common, owner, row_of[term])
    order = np.lexsort((rank, np.log2(np.maximum(n, 1)).astype(int), common))
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    height = max(1, int(max(len(n), len(used)) - 1).bit_length())
    apart = height - max(1, int(len(used) - 1).bit_length())
    treap = Treap(row_of[term] << apart, place[owner], value, height)
    by_place = np.full(1 << height, np.iinfo(np.int64).max)
    by_place[:len(n)] = rank[order]
    first_rank = np.concatenate([by_place.reshape(1 << level, -1).min(1) for level in range(height + 1)])
    out = [], [], []
    there = df > 0
    for i, (terms, asked) in enumerate(zip(queries.of, queries.times, strict=True)):
        held = there[terms]
        if not held.any():
            continue
        column, score = treap.search(row_of[terms[held]] << apart, asked[held], k, int(least[i]), first_rank, by_place)
        fine = score >= least[i]
        out[0].append(np.full(int(fine.sum()), i)), out[1].append(order[column[fine]]), out[2].append(score[fine])
        if len(score) == k:
            least[i] = max(least[i], score[-1])
    if not out[0]:
        return None
    item, row, score = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.take(pa.array(row)), pa.array(score)], ["number", "doc", "score"])


def best_of_blocks(index: DataFrame, sent, k: int) -> DataFrame:
    """(number, doc, score): the k best documents of every part of the index for each item of the round, or more."""
    kind = index.schema["_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, length = sent.value
        least = np.zeros(len(queries.of), np.int64)
        held, cells, rows = [], 0, 0
        for batch in batches:
            # slices of at most a block each
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells, "right")) - 1
                fits = min(max(fits, at + (not held)), at + BLOCK_DOCUMENTS - rows, batch.num_rows)
                if fits > at:
                    held.append(batch.slice(at, fits - at))
                    cells, rows, at = cells + int(ends[fits] - ends[at]), rows + fits - at, fits
                if at < batch.num_rows:
                    found = _search_block(held, queries, weights, documents, length, k, least)
                    if found is not None:
                        yield found
                    held, cells, rows = [], 0, 0
        found = _search_block(held, queries, weights, documents, length, k, least) if held else None
        if found is not None:
            yield found

    return index.filter("size(terms) > 0").mapInArrow(over, f"number int, doc {kind}, score bigint")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, item, rank, doc_id, score): the ``k`` best documents above 0 for each item, all if there are fewer.

    Equal scores stand by ascending id, null ids last; rows that repeat are documents of their own.
    Items that repeat with one id and text are one; items of one id and other texts are told apart
    by ``item``, a hash of both.  Null, empty and wordless texts hold no term: such documents are
    in no result, such items have none.  Without documents or items the result is empty.  Columns
    other than id and text are not looked at.
    """
    spark = docs.sparkSession
    asked = stage(item_terms(items, item_id, item_text))
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // ROUND_TERMS))
    found = []
    for r in range(rounds):
        # about ROUND_TERMS terms in one round
        got = asked.filter(F.pmod(F.xxhash64(F.lit(2), "item"), F.lit(rounds)) == r).filter("size(terms) > 0").orderBy("item").toArrow()
        sizes = np.diff(got["terms"].combine_chunks().offsets.to_numpy()) if len(got) else np.zeros(0, int)
        terms, where = np.unique(got["terms"].combine_chunks().flatten().to_numpy().view(np.uint64) if len(got) else np.zeros(0, np.uint64), return_inverse=True)
        vocabulary = Lookup(terms, np.zeros(len(terms)))
        number = vocabulary.find(terms)
        ends = np.cumsum(sizes)[:-1]
        times = got["times"].combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0, int)
        queries = Queries(vocabulary.keys, np.split(number[where], ends), np.split(times, ends)) if len(got) else Queries(terms, [], [])
        words = spark.sparkContext.broadcast(vocabulary)
        index = stage(forward_index(docs, words, id_column, text_column))
        n_docs, n_terms = index.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row for each query term
        counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(terms), np.int64)
        df[counts["term"].to_numpy()] = counts["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        sent = spark.sparkContext.broadcast((queries, weights, n_docs, n_terms))
        best = best_of_blocks(index, sent, k)
        best = _first(best.withColumn("_part", F.pmod(F.xxhash64("doc"), F.lit(MERGE_PARTS))), ["number", "_part"], k).drop("_part", "rank")
        names = spark.createDataFrame(pa.table({"number": pa.array(range(len(got)), pa.int32()), "item": got["item"], "item_id": got["item_id"]}))
        found.append(stage(_first(best, ["number"], k).join(F.broadcast(names), "number").select("item_id", "item", "rank", F.col("doc").alias(id_column), "score")))
        words.unpersist()
        sent.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
