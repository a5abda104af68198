"""N-gram Jaccard join with token-combination prefixes, and the components it links.

A document is the set of its word shingles; equal sets are one class from the start.  The
tokens (64-bit shingle hashes) stand in one global order: the rare ones, then the frequent, then
the very frequent, each by hash.  Rare tokens are indexed singly, frequent ones in combinations
of two, very frequent ones in combinations of three.  With d the most tokens a set may lack in a
partner, its prefix is extended until the tokens of each class, less one, two or no tokens for a
combination of two, three or one, are over d together.  Two linked sets then share a key: of the
two prefixes take the one that ends first; it lacks at most d of its tokens in the other set, so
of some class enough for a combination are common, and those lie inside the other prefix as well.
Larger sets have too many combinations: above a size they use combinations of one token less, and
sets near that size are indexed both ways.

Most linked sets are found before that: every set looks under its few least tokens, and what
shares one is compared with one member of the key, its pivot.  What is verified forms components.
The index is for the links between components: a token is frequent by the number of components
that it is met in, so a large group of near copies makes none, and keys inside one component say
nothing more.  The members of a key are first compared with its pivot, and only those of keys
that then still join several components with each other; a pair that shares many keys is made under
the least of them, as far as the least keys of both sets show it.  Sizes and a 256-bit parity sketch, then
one as long as the set, bound the symmetric difference from below, so pairs are dropped before
their sets are fetched, and never one that links.  What is left is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import bit_count_for, bits_of, in_bits, list_of, map_batches, stage
from repochron.llm.words import LOWER, NOT_SPACE, Run, mixed, runs, split_words

#: components of a token from which on it is frequent, and very frequent
FREQUENT, VERY_FREQUENT = 48, 1 << 10
#: most tokens that may lack (d) where combinations of two, and of three, are indexed
PAIRED, TRIPLED = 32, 8
#: least tokens under which a set looks for the first links
PROBES = 3
#: least bits of a parity sketch
SKETCH = 512
#: bits of the sketch that all pairs are compared by first
MINI = 256
#: tokens of a head beyond d and a quarter of it
HEAD = 10
#: least keys of a set that its index entries carry
CARRIED_KEYS = 16
#: bytes of texts that a task splits at once
CHUNK = 1 << 18


def run_sets(run: Run, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sizes): the sorted distinct shingle hashes of each text of a run, joined."""
    words = split_words(run, NOT_SPACE, LOWER)
    n = len(run.bounds) - 1
    begin = words.windows(k)
    text, token = [words.text[begin]], [words.window_hash(begin, k)]
    counts = words.counts
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        text.append(short)
        token.append(mixed(words.window_hash(words.first[short], size) + np.uint64(size)))
    text, token = np.concatenate(text), np.concatenate(token)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return token[fresh], np.bincount(text[fresh], minlength=n)


def lacking(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most tokens of a set of ``n`` that a linked set may lack."""
    return n - -(-num * n // den)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """A power of two of at least ``n`` bits."""
    return SKETCH << np.ceil(np.log2(np.maximum(n, SKETCH) / SKETCH)).astype(np.int64)


MINIS = [f"m{i}" for i in range(MINI // 64)]
#: what a class keeps of one of its rows
CARRIED = ["_h", "n", "head", "sketch", *MINIS]
MINI_SCHEMA = ", ".join(f"{m} bigint" for m in MINIS)


def mini_sketch(tokens: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
    """The parity sketches of ``MINI`` bits of ``n`` sets, a column for each 64 bits."""
    place = owner * MINI + (tokens >> np.uint64(20) & np.uint64(MINI - 1)).astype(np.int64)
    words = np.packbits((np.bincount(place, minlength=n * MINI) & 1).astype(np.uint8)).view(np.int64).reshape(n, -1)
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(MINI // 64)]


def _ranks(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def set_table(docs: DataFrame, k: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    """(_id, _h, n, set_id, head, sketch, m0...) of every row: size, hash of the set, its first tokens by hash.

    A head has the d + 1 tokens of a prefix without frequent tokens, and some more.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.xxhash64(F.col(text_column)).alias("_h"), F.col(text_column).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for run in runs(batch.column(2), CHUNK):
            tokens, sizes = run_sets(run, k)
            n = len(sizes)
            owner = np.repeat(np.arange(n), sizes)
            sums = np.zeros(len(tokens) + 1, np.uint64)
            np.cumsum(mixed(tokens), out=sums[1:])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = mixed(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64))
            first = _ranks(sizes) < np.repeat(lacking(sizes, num, den) * 5 // 4 + HEAD, sizes)
            mini = mini_sketch(tokens, owner, n)
            width = sketch_bits(sizes)
            base = np.cumsum(width) - width
            place = base[owner] + (tokens >> np.uint64(20) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
            sketch = np.packbits((np.bincount(place, minlength=width.sum()) & 1).astype(np.uint8)).view(np.int64)
            rows = batch.slice(run.rows.start, n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(sizes.astype(np.int64)), pa.array(ids.view(np.int64)),
                 list_of(np.bincount(owner[first], minlength=n), tokens[first].view(np.int64)), list_of(width // 64, sketch), *mini],
                ["_id", "_h", "n", "set_id", "head", "sketch", *MINIS])

    return map_batches(source, over, f"_id {kind}, _h bigint, n bigint, set_id bigint, head array<bigint>, sketch array<bigint>, {MINI_SCHEMA}")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int, text_column: str) -> DataFrame:
    """(set_id, tokens) of the classes in ``wanted`` (set_id, _h): texts outside a bit table of their hashes are not split; staged."""
    wanted = stage(wanted)
    if wanted.isEmpty():
        return wanted.select("set_id", F.array().cast("array<bigint>").alias("tokens"))
    table = send_bits(wanted, "_h")
    source = docs.select(F.xxhash64(F.col(text_column)).alias("_h"), F.col(text_column).cast("string").alias("_text"))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(in_bits(table.value, batch.column(0).to_numpy().view(np.uint64))))
        for run in runs(batch.column(1), CHUNK) if batch.num_rows else ():
            tokens, sizes = run_sets(run, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.rows.start, len(sizes)), list_of(sizes, tokens.view(np.int64))], ["_h", "tokens"])

    found = map_batches(source, over, "_h bigint, tokens array<bigint>").dropDuplicates(["_h"])
    sets = stage(found.join(wanted, "_h").select("set_id", "tokens"))
    table.unpersist()
    return sets


def send_bits(keys: DataFrame, column: str) -> Broadcast:
    """A bit table of 64-bit hashes, of bounded size, on the executors."""
    return keys.sparkSession.sparkContext.broadcast(bits_of(keys, column, bit_count_for(keys.count())))


def may_be_in(table: Broadcast) -> Callable[[Column], Column]:
    """A test of 64-bit hashes against a bit table: true for all keys in it, and for few others."""

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bits(table.value, hashes.to_numpy(np.int64).view(np.uint64)))

    return test


def size_limits(num: int, den: int) -> tuple[float, float, float]:
    """Set sizes up to which single tokens, combinations of three, and combinations of two are used where tokens are frequent.

    Sets of at most the first size may share fewer than four tokens with a partner.
    """
    apart = den / max(den - num, 1)
    return 4 * den / num, TRIPLED * apart, max(PAIRED * apart, TRIPLED * apart * den / num)


def key_sizes(n: int, num: int, den: int, limits: tuple[float, float, float]) -> set[tuple[int, int]]:
    """(tokens of a combination of frequent tokens, of very frequent ones) that a set of ``n`` tokens is indexed by.

    Sets that may be linked have one of them in common: a size within a factor of num / den of a limit has both.
    """
    small, triple, pair = limits
    kinds = ((0, small, (1, 1)), (small, triple, (2, 3)), (triple, pair, (2, 2)), (pair, float("inf"), (1, 1)))
    return {kind for low, high, kind in kinds if n * den > low * num and n * num <= high * den}


def keys_of(tokens: np.ndarray, level: np.ndarray, n: int, num: int, den: int, limits: tuple[float, float, float]) -> np.ndarray | None:
    """Index keys of a set of ``n`` tokens from its first ``tokens`` by hash and their classes (0, 1, 2); None if more are needed."""
    need = int(lacking(np.array(n), num, den)) + 1
    rare = tokens[level == 0]
    if len(rare) >= need:
        return rare[:need]
    if len(tokens) < n:
        return None
    out = [rare]
    for sizes in key_sizes(int(n), num, den, limits):
        left = need - len(rare)
        for c, size in enumerate(sizes, 1):
            part = tokens[level == c][:max(left, 0) + size - 1] if left > 0 else tokens[:0]
            if size == 1:
                out.append(mixed(part + np.uint64(1)))
            elif len(part) >= size:
                places = np.array(list(combinations(range(len(part)), size)))
                key = np.full(len(places), size, np.uint64)
                for column in places.T:
                    key = mixed(key * np.uint64(3) + mixed(part[column]))
                out.append(key)
            left -= max(0, len(part) - size + 1)
    return np.unique(np.concatenate(out))


def entries_of(sets: DataFrame, classes_of_tokens: Broadcast, num: int, den: int, shared: Broadcast | None = None) -> DataFrame:
    """(key, set_id, fresh) from (set_id, n, tokens): the index entries of the sets that these tokens decide.

    fresh tells that the key is not one of the first d + 1 tokens.  With ``shared``, keys outside that
    bit table are left out.
    """
    limits = size_limits(num, den)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(2)
        joined = column.flatten().to_numpy().view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
        often, very = classes_of_tokens.value
        level = in_bits(often, joined).astype(np.int8)
        level[level > 0] += in_bits(very, joined[level > 0])
        parts, owner, fresh = [], [], []
        for i, n in enumerate(batch.column(1).to_numpy()):
            a, b = ends[i], ends[i + 1]
            need = int(lacking(np.array(n), num, den)) + 1
            keys = joined[a:a + need] if not level[a:a + need].any() else keys_of(joined[a:b], level[a:b], n, num, den, limits)
            if keys is None:
                continue
            new = ~np.isin(keys, joined[a:a + need])
            keep = in_bits(shared.value, keys) if shared is not None else np.ones(len(keys), bool)
            parts.append(keys[keep]), owner.append(np.full(int(keep.sum()), i)), fresh.append(new[keep])
        if parts:
            rows = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), batch.column(0).take(rows), pa.array(np.concatenate(fresh))], ["key", "set_id", "fresh"])

    return map_batches(sets, over, "key bigint, set_id bigint, fresh boolean")


def undecided(classes: DataFrame, classes_of_tokens: Broadcast, num: int, den: int) -> DataFrame:
    """(set_id, _h) of the classes whose heads hold too few rare tokens."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        head = batch.column(3)
        sizes = np.diff(head.offsets.to_numpy())
        often = in_bits(classes_of_tokens.value[0], head.flatten().to_numpy().view(np.uint64))
        rare = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~often, len(sizes))
        n = batch.column(2).to_numpy()
        yield batch.select([0, 1]).filter(pa.array((rare <= lacking(n, num, den)) & (sizes < n)))

    return map_batches(classes.select("set_id", "_h", "n", "head"), over, "set_id bigint, _h bigint")


def near_in_size(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def near_in_sketch(a: Column, b: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Sketches differ in no more bits than the sets may differ in tokens.

    Sets near in size have sketches of one length or of two that differ by a factor of two; the
    halves of the longer one are laid over each other then.
    """
    size = F.least(F.size(a), F.size(b))
    differ = lambda x, y: x.bitwiseXOR(y)
    short = lambda x: F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), differ)).otherwise(x)
    bits = F.aggregate(F.zip_with(short(a), short(b), differ), F.lit(0), lambda t, x: t + F.bit_count(x))
    return bits * (den + num) <= (n + m) * (den - num)


def near_in_mini(a: str, b: str, n: str, m: str, num: int, den: int) -> Column:
    """The same for the short sketches, in columns that begin with ``a`` and ``b``."""
    differ = sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in MINIS[1:]), F.bit_count(F.col(f"{a}m0").bitwiseXOR(F.col(f"{b}m0"))))
    return differ * (den + num) <= (F.col(n) + F.col(m)) * (den - num)


def verified(pairs: DataFrame, known: DataFrame | None, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, text_column: str) -> DataFrame:
    """The (a, b) among pairs of classes that link and are not ``known``: by size and sketches, then by the whole sets; staged."""
    side = lambda s, columns: classes.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    near = pairs.distinct().join(side("a", ["n", *MINIS]), "a").join(side("b", ["n", *MINIS]), "b")
    near = near.filter(near_in_size(F.col("a_n"), F.col("b_n"), num, den) & near_in_mini("a_", "b_", "a_n", "b_n", num, den)).select("a", "b")
    near = stage(near if known is None else near.join(known, ["a", "b"], "left_anti"))
    if near.isEmpty():
        return near
    close = near.join(side("a", ["n", "sketch"]), "a").join(side("b", ["n", "sketch"]), "b")
    close = stage(close.filter(near_in_sketch(F.col("a_sketch"), F.col("b_sketch"), F.col("a_n"), F.col("b_n"), num, den)).select("a", "b"))
    ids = close.select(F.col("a").alias("set_id")).union(close.select(F.col("b").alias("set_id"))).distinct()
    sets = whole_sets(docs, ids.join(classes.select("set_id", "_h"), "set_id"), k, text_column)
    whole = lambda s: sets.select(F.col("set_id").alias(s), F.col("tokens").alias(f"t{s}"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = close.join(whole("a"), "a").join(whole("b"), "b").filter(both * den >= (F.size("ta") + F.size("tb") - both) * num)
    return stage(met.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that is reachable, for the nodes of (a, b) edges.

    Alternating large-star and small-star steps: every node hands its least neighbour to the
    others, by partial minima and joins, and no neighbourhood is gathered.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = stage(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    # now every node points at the least node of its component
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def first_links(classes: DataFrame) -> DataFrame:
    """(a, b): every class with the pivot of each of its least tokens."""
    probes = classes.select("set_id", F.explode(F.slice("head", 1, PROBES)).alias("key"))
    pivots = probes.groupBy("key").agg(F.min("set_id").alias("pivot"), F.count("*").alias("c")).filter("c > 1").select("key", "pivot")
    return probes.join(pivots, "key").filter("set_id <> pivot").select(*ordered_pair("set_id", "pivot"))


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with the component (comp) of their set_id; a set without links is its own."""
    return rows.join(comps.select(F.col("node").alias("set_id"), "comp"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))


def token_classes(entries: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of (key, set_id) that are frequent, and those that are very frequent; staged."""
    met = with_components(entries.select("key", "set_id"), comps).select("key", "comp").distinct()
    counts = stage(met.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT))
    return counts.select("key"), counts.filter(F.col("c") > VERY_FREQUENT).select("key")


def index_entries(docs: DataFrame, classes: DataFrame, comps: DataFrame, k: int, num: int, den: int, text_column: str) -> DataFrame:
    """(key, set_id): the index of all classes, without most of the keys that only one class has; staged."""
    need = (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int")
    heads = classes.select("set_id", "n", "head")
    prefixes = classes.select("set_id", F.explode(F.slice("head", F.lit(1), need)).alias("key"))
    shared = stage(prefixes.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    many = send_bits(stage(shared.filter(F.col("c") > FREQUENT).select("key")), "key")
    often, very = token_classes(stage(prefixes.filter(may_be_in(many)(F.col("key")))), comps)
    some = classes.sparkSession.sparkContext.broadcast(tuple(bits_of(t, "key", bit_count_for(t.count())) for t in (often, very)))
    # sets that frequent tokens fill: all their tokens tell what else is frequent
    hot = whole_sets(docs, undecided(classes, some, num, den), k, text_column)
    more, more_very = token_classes(hot.select("set_id", F.explode("tokens").alias("key")), comps)
    often, very = stage(often.union(more).distinct()), stage(very.union(more_very).distinct())
    all_ = classes.sparkSession.sparkContext.broadcast(tuple(bits_of(t, "key", bit_count_for(t.count())) for t in (often, very)))
    open_ = stage(undecided(classes, all_, num, den))
    rest = whole_sets(docs, open_.join(hot.select("set_id"), "set_id", "left_anti"), k, text_column)
    whole = hot.join(open_.select("set_id"), "set_id", "left_semi").union(rest).select("set_id", F.size("tokens").cast("long").alias("n"), "tokens")
    extended = stage(entries_of(whole, all_, num, den))
    # a key that is in one prefix only because of its class may be among the first tokens of another set
    fresh = entries_of(heads, all_, num, den).filter("fresh").select("key")
    kept = send_bits(stage(shared.select("key").union(extended.select("key")).union(fresh).distinct()), "key")
    entries = stage(entries_of(heads, all_, num, den, kept).union(extended).select("key", "set_id"))
    for sent in (many, some, all_, kept):
        sent.unpersist()
    return entries


def with_least_keys(members: DataFrame) -> DataFrame:
    """(key, set_id...) with the least keys (least_keys) of each set among these rows; staged."""
    members = stage(members)
    least = members.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED_KEYS).alias("least_keys"))
    return members.join(least, "set_id")


def pairs_across(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): sets of different components that meet under a key, not both with its pivot, and that sizes and short sketches let link.

    Near copies share most of their keys.  A pair is left out under a key that is not the least of
    those that the least keys of both sets have in common: it is made under that one.
    """
    outside = members.filter("not with_pivot")
    right = members.select("key", *[F.col(c).alias(f"r_{c}") for c in ("set_id", "comp", "with_pivot", "n", "least_keys", *MINIS)])
    least = F.array_min(F.array_intersect("least_keys", "r_least_keys"))
    across = outside.join(right, "key").filter(
        (F.col("comp") != F.col("r_comp")) & (F.col("r_with_pivot") | (F.col("set_id") < F.col("r_set_id"))) & near_in_size(F.col("n"), F.col("r_n"), num, den)
        & near_in_mini("", "r_", "n", "r_n", num, den) & (F.coalesce(least, "key") == F.col("key")))
    return across.select(*ordered_pair("set_id", "r_set_id"))


def linked_classes(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, text_column: str) -> DataFrame:
    """(node, comp): components of the classes that have a link."""
    # smaller sets have no partner but equal ones
    classes = classes.filter(F.floor(F.col("n") * den / num) > F.col("n"))
    check = lambda pairs, known=None: verified(pairs, known, docs, classes, k, num, den, text_column)
    links = check(first_links(classes))
    comps = stage(components(links))

    entries = index_entries(docs, classes, comps, k, num, den, text_column)
    keys = stage(entries.groupBy("key").agg(F.count("*").alias("c"), F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("c > 1"))
    # a key of two sets is a pair; in others all members meet the pivot
    several = keys.filter("c > 2").select("key", F.col("a").alias("pivot"))
    members = stage(with_components(entries.join(several, "key"), comps))
    open_keys = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    members = stage(members.join(open_keys, "key", "left_semi"))
    pivot_comp = members.filter("set_id = pivot").select("key", F.col("comp").alias("pivot_comp"))
    star = members.join(pivot_comp, "key").filter("comp <> pivot_comp").select(*ordered_pair("set_id", "pivot"))
    links = links.union(check(keys.filter("c = 2").select("a", "b").union(star), links))

    # all pairs with a pivot are decided: other members meet where a key still joins components
    if members.isEmpty():
        return components(links)
    comps = stage(components(links))
    members = with_components(members.select("key", "set_id", "pivot"), comps)
    pivot_comp = members.filter("set_id = pivot").select("key", F.col("comp").alias("pivot_comp"))
    members = members.filter("set_id <> pivot").join(pivot_comp, "key").select("key", "set_id", "comp", (F.col("comp") == F.col("pivot_comp")).alias("with_pivot"))
    members = stage(members)
    open_keys = stage(members.filter("not with_pivot").select("key").distinct())
    if open_keys.isEmpty():
        return comps
    members = with_least_keys(members.join(open_keys, "key", "left_semi"))
    members = stage(members.join(classes.select("set_id", "n", *MINIS), "set_id"))
    return components(links.union(check(pairs_across(members, num, den), links)))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", keep_hash: bool = False) -> DataFrame:
    """(id, n_shingles, set_id, component_id): linked if ``den * |A and B| >= num * |A or B|``.

    One row for each row of ``docs``.  A text of fewer words than a shingle is one shingle of all
    its words; a text without words, or null, has no shingles, a null set_id and is its own
    component.  component_id is the least id of all rows of the linked classes (nulls only if
    there is no other).  Repeated rows have equal results; an empty table gives an empty result.
    Other columns are not looked at.  ``keep_hash`` adds the text hash (_h) and the least set_id of the
    linked classes (_comp, null without shingles), which tells components apart where ids do not.
    """
    table = stage(set_table(docs, shingle, num, den, id_column, text_column))
    filled = table.filter("n > 0")
    twice = send_bits(stage(filled.groupBy("set_id").agg(F.count("*").alias("c")).filter("c > 1").select("set_id")), "set_id")
    repeated = may_be_in(twice)(F.col("set_id"))
    single = filled.filter(~repeated).select("set_id", F.col("_id").alias("least"), *CARRIED)
    several = filled.filter(repeated).groupBy("set_id").agg(F.min("_id").alias("least"), *[F.min(c).alias(c) for c in CARRIED])
    classes = stage(single.union(several))
    twice.unpersist()
    comps = stage(linked_classes(docs, classes, shingle, num, den, text_column))
    known = classes.select("set_id", "least").join(comps, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("comp", "set_id").alias("comp"))
    labels = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    per_set = known.join(labels, "comp").select(F.col("set_id").alias("_set"), "component_id", F.col("comp").alias("_comp"))
    out = table.select("_id", "_h", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return out.join(per_set, F.col("set_id") == F.col("_set"), "left").select(
        F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), "set_id", F.coalesce("component_id", "_id").alias("component_id"), *(["_h", "_comp"] if keep_hash else []))


def one_of_each(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: the one of the least id (then of the least text hash).

    Rows without words are groups of their own; rows that repeat with one id and text are one.
    """
    table = near_duplicates(docs, shingle=shingle, num=num, den=den, id_column=id_column, text_column=text_column, keep_hash=True)
    rows = stage(table.groupBy(F.col(id_column).alias("_id"), "_h", "_comp").agg(F.count("*").alias("n")))
    filled = rows.filter("_comp is not null")
    first = filled.groupBy("_comp").agg(F.min(F.struct("_id", "_h")).alias("first"))
    kept = F.struct("_id", "_h").eqNullSafe(F.col("first"))
    marked = filled.join(first, "_comp").select("_id", "_h", "n", kept.alias("_kept"))
    bare = rows.filter("_comp is null").select("_id", "_h", "n", F.lit(True).alias("_kept"))
    # few rows as a rule, and written, so that the joins know their size
    leaves = stage(marked.union(bare).filter("not _kept or n > 1").select("_id", "_h", "_kept"))
    # the rows of docs go through the joins as one column, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_column).alias("_key"), F.xxhash64(F.col(text_column)).alias("_hash"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    single = packed.join(leaves, same, "left_anti")
    repeated = packed.join(leaves.filter("_kept"), same, "left_semi").dropDuplicates(["_key", "_hash"])
    return single.union(repeated).select("_row.*")
