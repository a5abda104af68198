"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of a benchmark item, or a whole shorter item.  Its
tokens are its word shingles.  A document holds a window only if it holds all its shingles,
so the necessary prefix of a window is its rarest shingle: the one least frequent in the
documents.  Documents are joined with these rarest shingles only; where one occurs, the
position fixes where the window would have to lie, the bounds of the document are applied,
and the words there are compared one by one.

Documents are read twice and never shuffled: once to count the benchmark's shingles in them,
once to pick the occurrences of the rarest ones with the words around them.  Both passes
drop other shingles through a bit table of bounded size, so what is shuffled follows the
benchmark's words in the documents and not the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import bit_count_for, bits_of, in_bits, map_batches, stage
from repochron.llm.words import ALNUM, LOWER, Run, Words, runs, split_words

WINDOW = 10
#: words of a shingle; windows of fewer words are one shingle
SHINGLE = 3


def _shingle(words: Words, begin: np.ndarray, k: int) -> np.ndarray:
    return words.window_hash(begin, k) ^ np.uint64(k)



def _normal(run: Run, words: Words, a: int, b: int) -> list[str]:
    return [LOWER[run.data[words.start[i]:words.end[i]]].tobytes().decode() for i in range(a, b)]


def item_windows(items: DataFrame, window: int, *, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, words, shingles): the windows of every item with their shingle hashes in order."""
    source = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text"))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(1)):
            words = split_words(run, ALNUM, LOWER)
            ids, texts, shingles = [], [], []
            for i in range(len(run.bounds) - 1):
                a, b = int(words.first[i]), int(words.first[i + 1])
                spelled = _normal(run, words, a, b)
                size = min(window, b - a)
                k = min(SHINGLE, size)
                for w in range(b - a - size + 1 if size else 0):
                    ids.append(run.rows.start + i)
                    texts.append(spelled[w:w + size])
                    shingles.append(_shingle(words, np.arange(a + w, a + w + size - k + 1), k).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.int64()))],
                ["item_id", "words", "shingles"])

    kind = source.schema["item_id"].dataType.simpleString()
    return map_batches(source, over, f"item_id {kind}, words array<string>, shingles array<bigint>")


def _hits(run: Run, words: Words, sizes: list[int], table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes) of the shingles in a run that may be in the table."""
    for k in sizes:
        begin = words.windows(k)
        hashes = _shingle(words, begin, k)
        found = in_bits(table, hashes)
        yield k, begin[found], hashes[found]


def shingle_counts(docs: DataFrame, text_column: str, sizes: list[int], table) -> DataFrame:
    """(shingle, df): occurrences in all documents, for the shingles in the table."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)] + [h for run in runs(batch.column(0)) for _, _, h in _hits(run, split_words(run, ALNUM, LOWER), sizes, table.value)]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "df"])

    source = docs.select(F.col(text_column).cast("string"))
    return map_batches(source, over, "shingle bigint, df bigint").groupBy("shingle").agg(F.sum("df").alias("df"))


def scan_documents(docs: DataFrame, id_column: str, text_column: str, sizes: list[int], window: int, table) -> DataFrame:
    """(_id, _h, n_words, found): every document with the occurrences of the shingles in the table.

    An occurrence has its shingle, its word position, and the words that a window over it can reach.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.xxhash64(F.col(text_column)).alias("_h"), F.col(text_column).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    found_type = pa.struct([("shingle", pa.int64()), ("pos", pa.int64()), ("from", pa.int64()), ("words", pa.list_(pa.string()))])

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(2)):
            words = split_words(run, ALNUM, LOWER)
            n = len(run.bounds) - 1
            lists: list[list] = [[] for _ in range(n)]
            for k, begin, hashes in _hits(run, words, sizes, table.value):
                for b, h in zip(begin.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    i = int(words.text[b])
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    a, z = max(first, b - window + k), min(last, b + window)
                    lists[i].append({"shingle": h, "pos": b - first, "from": a - first, "words": _normal(run, words, a, z)})
            rows = batch.slice(run.rows.start, n)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words.counts.astype(np.int64)), pa.array(lists, pa.list_(found_type))], ["_id", "_h", "n_words", "found"])

    return map_batches(source, over, f"_id {kind}, _h bigint, n_words bigint, found array<struct<shingle: bigint, pos: bigint, from: bigint, words: array<string>>>")


def contaminated_spans(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, found): (_id, _h, n_words); (_id, _h, start, length, window); (window, item_id)."""
    spark = docs.sparkSession
    windows = stage(item_windows(items, window, id_column=item_id, text_column=item_text).withColumn("window", F.array_join("words", " ")))
    tokens = windows.select(F.explode("shingles").alias("shingle")).distinct()
    sizes = sorted(min(SHINGLE, row["n"]) for row in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect())
    table = spark.sparkContext.broadcast(bits_of(tokens, "shingle", bit_count_for(tokens.count())))
    counts = shingle_counts(docs, text_column, sizes, table)
    distinct = windows.select("window", "words", "shingles").dropDuplicates(["window"])
    placed = distinct.select("window", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle", "left")
    # a shingle that no document holds is the rarest: the window cannot occur
    rarest = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("r"))
    prefixes = stage(rarest.filter("r.df > 0").select("window", F.split("window", " ").alias("w"), F.col("r.shingle").alias("shingle"), F.col("r.offset").cast("long").alias("offset")))
    chosen = prefixes.select("shingle").distinct()
    picked = spark.sparkContext.broadcast(bits_of(chosen, "shingle", bit_count_for(chosen.count())))
    scanned = stage(scan_documents(docs, id_column, text_column, sizes, window, picked))
    occurrences = scanned.filter("size(found) > 0").select("_id", "_h", "n_words", F.explode("found").alias("f")).select("_id", "_h", "n_words", "f.*")
    start = F.col("pos") - F.col("offset")
    length = F.size("w")
    here = F.slice("words", (start - F.col("from") + 1).cast("int"), length)
    joined = occurrences.join(prefixes, "shingle").filter((start >= 0) & (start >= F.col("from")) & (start + length <= F.col("n_words")))
    spans = joined.filter(here == F.col("w")).select("_id", "_h", start.alias("start"), length.alias("length"), "window")
    return scanned.select("_id", "_h", "n_words"), spans, windows.select("window", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, _h, n_words, n_hit, item_ids): words inside occurrences of windows, and the items they are of.

    One row for each row of ``docs``.  A null or empty text, or one of other characters only, has
    no words and no hits; items without words are never met; equal items are all listed.  Rows
    that repeat have equal results; rows of one id and other texts are kept apart by ``_h``, the
    hash of the text.  Empty documents give an empty table, an empty benchmark no hits.  Columns
    other than id and text are not looked at.
    """
    scanned, spans, found = contaminated_spans(docs, items, window=window, id_column=id_column, text_column=text_column, item_id=item_id, item_text=item_text)
    spans = stage(spans)
    per_doc = spans.groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))

    def cover(acc, x):
        end = x["start"] + x["length"]
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + fresh).alias("hit"))

    hits = per_doc.select("_id", "_h", F.aggregate("s", zero, cover, lambda acc: acc["hit"]).alias("n_hit"))
    ids = spans.select("_id", "_h", "window").distinct().join(found, "window").groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    hits = hits.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "n_hit")
    ids = ids.select(F.col("_id").alias("_j"), F.col("_h").alias("_k"), "item_ids")
    joined = scanned.join(hits, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").join(
        ids, F.col("_id").eqNullSafe(F.col("_j")) & (F.col("_h") == F.col("_k")), "left")
    return joined.select(F.col("_id").alias(id_column), "_h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item.

    Rows without words, and all rows where there are no items, stay; repeated rows stay or go together.
    """
    _, spans, _ = contaminated_spans(docs, items, window=window, id_column=id_column, text_column=text_column)
    hit = stage(spans.select("_id", "_h").distinct())
    # the rows of docs go through the join as one column, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_column).alias("_key"), F.xxhash64(F.col(text_column)).alias("_hash"))
    return packed.join(hit, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_anti").select("_row.*")
