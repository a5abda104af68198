"""Allow and block rules for URLs: a blocked Bloom filter, then an exact hash join.

Everything is DataFrame functions.  A URL has one key for each host suffix and each path
prefix whose length occurs in the list.  Keys that the filter cannot hold end there; the
few that pass meet the list in a shuffled hash join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import bit_at, lower_ascii, stage

#: a block is one 64-bit word; a key sets up to this many of its bits
PROBES = 4
KEYS_A_BLOCK = 4
#: the filter that is sent to the executors has at most so many blocks of 16 bytes
MAX_BLOCKS = 1 << 18
#: a rule that holds more than this part of the passed keys is dealt to so many places (there are at most ``1 / HOT_SHARE`` such rules)
HOT_SHARE, PLACES = 1 / 1000, 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _mask(key: Column) -> Column:
    """The bits of a key inside its block, from a second hash."""
    h = F.xxhash64(F.lit(1), key)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(bit_at(F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63))))
    return mask


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): hosts lower-cased; rows with a null are left out.

    Of rules that repeat with other actions the first action in the alphabet holds.
    """
    clean = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("action")).dropna().filter("host <> ''")
    return clean.groupBy("host", "path").agg(F.min("action").alias("action")).withColumn("rule", _key(F.col("host"), F.col("path")))


def filter_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (block, bits); at most ``blocks`` rows, made by a partial aggregation."""
    return rules.groupBy(_block(F.col("rule"), blocks).alias("_block")).agg(F.bit_or(_mask(F.col("rule"))).alias("_bits"))


def url_keys(host: Column, path: Column, lengths: Column) -> Column:
    """Structs (host, path, key) of a URL: host suffixes at dots x path prefixes of the listed lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with (host, path, rule, verdict); ``rules`` has (host, path, action).

    A rule fits its host and the hosts below it if the path begins with the rule's path; the
    longest fitting rule wins (host and path together; of two equally long ones the longer
    host).  A URL without a fitting rule gets a null rule and ``default``.  A null URL, or one
    without ``://``, has an empty host and path.  Repeated pages are judged each; an empty
    table of pages or rules is no error.  Columns of ``pages`` with a result's name are replaced.
    """
    listed = canonical_rules(rules)
    n, lengths = listed.agg(F.count("*"), F.sort_array(F.collect_set(F.length("path")))).first()
    blocks = min(MAX_BLOCKS, max(1, n // KEYS_A_BLOCK))
    pages = pages.drop("host", "path", "rule", "verdict")
    # the rows of pages go through the join as one column, so that no name can clash
    pages = pages.select(F.struct(*pages.columns).alias("_row"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    urls = pages.select("host", "path").distinct()
    keys = urls.filter("host <> ''").select("host", "path", F.explode(url_keys(F.col("host"), F.col("path"), F.array(*[F.lit(x) for x in lengths or []]).cast("array<int>"))).alias("_k"))
    keys = keys.withColumn("_rule", _key(F.col("_k.host"), F.col("_k.path"))).withColumn("_block", _block(F.col("_rule"), blocks))
    passed = keys.join(F.broadcast(filter_blocks(listed, blocks)), "_block").filter(F.col("_bits").bitwiseAND(_mask(F.col("_rule"))) == _mask(F.col("_rule")))
    best = _exact_hits(stage(passed.select("host", "path", "_k", "_rule")), listed).groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length("_h").alias("m"), F.col("rule"), F.col("action"))).alias("_best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select("_row.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))


def _exact_hits(passed: DataFrame, listed: DataFrame) -> DataFrame:
    """The passed keys that are listed, by a hash join; rules that very many URLs have are dealt to ``PLACES`` tasks."""
    counts = stage(passed.groupBy("_rule").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") > HOT_SHARE * total).select(F.col("_rule").alias("_hot")))
    places = F.when(F.col("_hot").isNull(), 1).otherwise(PLACES)
    dealt = passed.join(hot, F.col("_rule") == F.col("_hot"), "left").withColumn("_place", F.pmod(F.xxhash64("host", "path"), places).cast("int"))
    exact = listed.join(hot, F.col("rule") == F.col("_hot"), "left").select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", "action", F.explode(F.sequence(F.lit(0), places - 1)).alias("_at")).hint("shuffle_hash")
    return dealt.join(exact, (F.col("_k.host") == F.col("_h")) & (F.col("_k.path") == F.col("_p")) & (F.col("_place") == F.col("_at")))
