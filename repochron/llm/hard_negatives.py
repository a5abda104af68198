"""Hard negatives by best-first search in STR-packed R-trees.

The rows are dealt by ranges of label and first coordinate.  A task packs its rows into R-trees of
a fixed size by Sort-Tile-Recursive: rows are sorted by label, then cut into slabs along the
coordinates of greatest spread, slab by slab.  A node has the least and the greatest value of every
coordinate below it.  With an anchor each coordinate gives an interval of products, their sums
the interval of inner products that rows below the node can have.

An anchor keeps a queue of nodes and opens those of the greatest upper bounds first.  A node is
dropped when its upper bound is strictly below the k-th score, when its interval lies outside all
score windows, or when its labels cannot serve.  Two searches follow each other: the nearest rows
of the anchor's label are its positives; each positive opens a window of scores, and the nearest
rows of other labels inside it are the negatives.

Anchors grow with the table, so they are sent in rounds of a bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.llm.common import stage

#: rows of a tree, of a leaf, and children of an inner node
BLOCK_ROWS, LEAF_ROWS, FANOUT = 1 << 13, 1 << 7, 8
#: coordinates that slabs are cut along
TILED = 3
#: nodes that are opened together
OPENED = 8
#: bytes of the anchors of a round
ROUND_BYTES = 32 << 20


def _tiles(values: np.ndarray, rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
    """``rows`` cut into leaves along the axes, in order."""
    leaves = -(-len(rows) // LEAF_ROWS)
    if leaves <= 1:
        return [rows]
    rows = rows[np.argsort(values[rows, axes[0]], kind="stable")] if len(axes) else rows
    if len(axes) <= 1:
        return np.array_split(rows, leaves)
    slabs = int(np.ceil(leaves ** (1 / len(axes))))
    return [leaf for slab in np.array_split(rows, slabs) if len(slab) for leaf in _tiles(values, slab, axes[1:])]


class Tree:
    """R-tree of labelled vectors, packed by sorting and tiling; nodes level by level, the root first."""

    def __init__(self, values: np.ndarray, labels: np.ndarray):
        axes = np.argsort(-values.var(0), kind="stable")[:TILED] if values.shape[1] else np.zeros(0, int)
        by_label = np.argsort(labels, kind="stable")
        groups = np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1)
        leaves = [leaf for group in groups for leaf in _tiles(values, group, axes)]
        self.order = np.concatenate(leaves)
        self.values, self.labels = values[self.order], labels[self.order]
        ends = np.cumsum([len(leaf) for leaf in leaves])
        first = np.concatenate([[0], ends[:-1]])
        level = [np.minimum.reduceat(self.values, first), np.maximum.reduceat(self.values, first), np.minimum.reduceat(self.labels, first), np.maximum.reduceat(self.labels, first)]
        levels, spans = [level], [np.stack([first, ends], 1)]
        while len(levels[-1][0]) > 1:
            start = np.arange(0, len(levels[-1][0]), FANOUT)
            span = np.stack([start, np.minimum(start + FANOUT, len(levels[-1][0]))], 1)
            levels.append([f.reduceat(x, start) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), levels[-1], strict=True)])
            spans.append(span)
        levels.reverse(), spans.reverse()
        sizes = np.array([len(s) for s in spans])
        below = np.concatenate([np.cumsum(sizes)[:-1], [0]])  # of leaves the span is one of rows
        self.low, self.high, self.least_label, self.most_label = (np.concatenate([level[i] for level in levels]) for i in range(4))
        self.span = np.concatenate([s + b for s, b in zip(spans, below, strict=True)])
        self.inner = int(sizes[:-1].sum())

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of every anchor with the rows below every node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def rows_below(self, leaves: np.ndarray) -> np.ndarray:
        start, end = self.span[leaves, 0], self.span[leaves, 1]
        size = end - start
        return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


@dataclass
class Anchors:
    """Anchors of a round: number, vector, label, row; and, for negatives, windows of scores (low, high) for each."""

    values: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    first: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def best_first(tree: Tree, anchor: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], usable: np.ndarray, fits: np.ndarray, tie: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every window [low, high] the (rows, scores) of its k best rows among those that fit, equal scores by ``tie``.

    ``usable`` tells nodes whose labels can serve, ``kth`` has scores below which nothing is wanted and is raised.
    """
    least, most = bounds
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in low]
    queue = np.zeros(1, np.int64)
    while True:
        wanted = np.maximum(low, kth)
        queue = queue[usable[queue] & ((most[queue][:, None] >= wanted) & (least[queue][:, None] <= high)).any(1)]
        if not len(queue):
            return best
        if len(queue) > OPENED:
            split = np.argpartition(-most[queue], OPENED - 1)
            now, queue = queue[split[:OPENED]], queue[split[OPENED:]]
        else:
            now, queue = queue, queue[:0]
        leaves, inner = now[now >= tree.inner], now[now < tree.inner]
        if len(inner):
            queue = np.concatenate([queue, tree.rows_below(inner)])
        if not len(leaves):
            continue
        rows = tree.rows_below(leaves)
        rows = rows[fits[rows]]
        scores = tree.values[rows] @ anchor
        for w in np.flatnonzero(scores.max(initial=-np.inf) >= wanted) if len(rows) else ():
            inside = (scores >= wanted[w]) & (scores <= high[w])
            if inside.any():
                r, s = np.concatenate([best[w][0], rows[inside]]), np.concatenate([best[w][1], scores[inside]])
                order = np.lexsort((tie[r], -s))[:k]
                best[w] = r[order], s[order]
                if len(order) == k:
                    kth[w] = max(kth[w], s[order[-1]])


def _padded(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers as floats, zeros after the end of a shorter row."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def search_trees(index: DataFrame, sent, width: int, k: int) -> DataFrame:
    """(anchor, window, id, score, row): of every tree the k best rows for each anchor (window -1), or for each of its windows.

    Without windows the rows of the anchor's label are searched, and itself is left out; with
    windows the rows of other labels.
    """
    kind = index.schema["_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        windows = anchors.first is not None
        kth = np.full(len(anchors.low) if windows else len(anchors.rows), -np.inf)
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == BLOCK_ROWS:
                    yield from block(held, anchors, windows, kth)
                    held, count = [], 0
        if held:
            yield from block(held, anchors, windows, kth)

    def block(parts: list[pa.RecordBatch], anchors: Anchors, windows: bool, kth: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, own = table["_id"].combine_chunks(), table["_row"].to_numpy()
        tree = Tree(_padded(table["_v"].combine_chunks(), width), table["_label"].to_numpy())
        rank = np.empty(len(own), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(own))
        tie, own = rank[tree.order], own[tree.order]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a in range(0, len(anchors.rows), 1024):
            chunk = slice(a, a + 1024)
            least, most = tree.intervals(anchors.values[chunk])
            for i, (label, row) in enumerate(zip(anchors.labels[chunk], anchors.rows[chunk], strict=True)):
                j = a + i
                if windows:
                    mine = slice(anchors.first[j], anchors.first[j + 1])
                    if mine.start == mine.stop:
                        continue
                    low, high, need = anchors.low[mine], anchors.high[mine], kth[mine]
                    usable, fits = (tree.least_label != label) | (tree.most_label != label), tree.labels != label
                else:
                    low, high, need = np.array([-np.inf]), np.array([np.inf]), kth[j:j + 1]
                    usable, fits = (tree.least_label <= label) & (tree.most_label >= label), (tree.labels == label) & (own != row)
                if not usable[0]:
                    continue
                for w, (rows, scores) in enumerate(best_first(tree, anchors.values[j], (least[i], most[i]), usable, fits, tie, low, high, k, need)):
                    out[0].append(np.full(len(rows), j)), out[1].append(np.full(len(rows), w if windows else -1)), out[2].append(rows), out[3].append(scores)
        if out[0]:
            anchor, window, rows, scores = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(window.astype(np.int32)), ids.take(pa.array(tree.order[rows])), pa.array(scores.astype(np.int64)), pa.array(own[rows])], ["anchor", "window", "id", "score", "row"])

    return index.select("_id", "_row", "_label", "_v").mapInArrow(over, f"anchor int, window int, id {kind}, score bigint, row bigint")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vector_index(vectors: DataFrame, anchor: Column, *, id_column: str, vector_column: str, label: Column, scale: int) -> DataFrame:
    """(_id, _row, _label, _v, _anchor), dealt by ranges of label and first coordinate; staged.

    _v has floor(``scale`` x) of every component; rows without a label, or with a missing or
    non-finite component or vector, are not in it.
    """
    value = lambda x: F.floor(scale * x.cast("double"))
    usable = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(label.isNotNull() & F.col(vector_column).isNotNull() & usable).select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"), label.cast("long").alias("_label"), F.transform(vector_column, value).alias("_v"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    rows = stage(rows)
    parts = max(1, -(-rows.count() // BLOCK_ROWS))
    return stage(rows.repartitionByRange(parts, "_label", F.try_element_at("_v", F.lit(1)), "_row"))


def mine_hard_negatives(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor is a row where ``anchor`` is true.  Its positives are the ``positives`` other rows of
    its label with the greatest scores, a score being the inner product of the vectors scaled to
    whole numbers.  For each of them come the ``negatives`` best rows of other labels with
    low * positive <= 100 * negative <= high * positive.  Equal scores stand by id (null ids last),
    then by row.  Vectors of other lengths count as filled up with zeros.  Rows without label or
    vector, or with a missing or non-finite component, take no part.  Rows that repeat are rows of
    their own, so they are each other's positives.  An anchor without positives, and a positive
    without rows in its window, give no row; an empty table an empty result.  Other columns are not
    looked at.  Scores are exact below 2**53.
    """
    spark = vectors.sparkSession
    index = vector_index(vectors, anchor, id_column=id_column, vector_column=vector_column, label=F.col(label) if isinstance(label, str) else label, scale=scale)
    width = index.agg(F.coalesce(F.max(F.size("_v")), F.lit(0))).first()[0]
    chosen = index.filter("_anchor")
    rounds = max(1, -(-chosen.count() * 8 * max(width, 1) // ROUND_BYTES))
    out = []
    for r in range(rounds):
        # about ROUND_BYTES of anchors
        got = chosen.filter(F.pmod(F.xxhash64("_row"), F.lit(rounds)) == r).select("_id", "_row", "_label", "_v").orderBy("_row").toArrow()
        anchors = Anchors(_padded(got["_v"].combine_chunks(), width) if len(got) else np.zeros((0, width)), got["_label"].to_numpy(), got["_row"].to_numpy())
        sent = spark.sparkContext.broadcast(anchors)
        near = stage(_first(search_trees(index, sent, width, positives), ["anchor"], positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")))
        # at most ``positives`` rows for each anchor of the round
        windows = near.orderBy("anchor", "window").select("anchor", "positive_score").toArrow()
        score = windows["positive_score"].to_numpy().astype(np.int64)
        counts = np.bincount(windows["anchor"].to_numpy(), minlength=len(got))
        anchors = Anchors(anchors.values, anchors.labels, anchors.rows, np.concatenate([[0], np.cumsum(counts)]), -(-low * score // 100).astype(float), (high * score // 100).astype(float))
        sent_windows = spark.sparkContext.broadcast(anchors)
        far = _first(search_trees(index, sent_windows, width, negatives), ["anchor", "window"], negatives)
        names = F.broadcast(spark.createDataFrame(pa.table({"anchor": pa.array(range(len(got)), pa.int32()), "anchor_id": got["_id"]})))
        out.append(stage(far.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor", "window"]).join(names, "anchor")
                         .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        sent.unpersist(), sent_windows.unpersist()
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found
