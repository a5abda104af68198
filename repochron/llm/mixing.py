"""Soft-membership mixing of documents to target weights of domains, by DataFrame functions only.

A classifier learned from a table of labels gives every document a posterior over domains.
Non-negative rates of the documents are then fitted so that the expected tokens of every
domain meet the targets: least squares, solved by projected gradient steps.  In the token
weighted metric a step moves the rate of a document by its posterior times one vector, so
documents of equal posterior always have equal rates; the steps therefore run over the table
of distinct posteriors, and only sums with one entry for each (pair of) domain reach the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import lower_ascii, stage

#: labelled rows that the classifier is fitted on, the first in hash order of their id
SAMPLE_ROWS = 12_000
#: words of evidence kept for each domain
EVIDENCE_WORDS = 200
#: a word is evidence for a domain from this log ratio and this significance on
LEAST_RATIO, LEAST_SIGMA = 1.0, 4.0
#: no word holds a space
FEW_WORDS = "few words"
MAX_STEPS = 30
LEAST_GAIN = 0.02
TOLERANCE = 1e-6

#: domains of the labels table, in the order of the posterior; the first is the ground state
DOMAINS = ["plain", "low", "toxic"]


def domain_of() -> Column:
    """Position in ``DOMAINS`` of a row of labels; null where a label is missing."""
    return F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def words_of(text: Column) -> Column:
    """Lower-cased words without sentence marks; none for null."""
    plain = F.translate(lower_ascii(F.coalesce(text, F.lit(""))), ".,;:()\"?", "        ")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def signs_of(words: Column) -> Column:
    """The distinct words, and a mark of its own for a text that repeats few of them."""
    distinct = F.array_distinct(words)
    few = (F.size(words) >= 10) & (F.size(distinct) * 4 < F.size(words))
    return F.when(few, F.concat(distinct, F.array(F.lit(FEW_WORDS)))).otherwise(distinct)


def _value_in(table: Column):
    return lambda word: F.coalesce(F.element_at(table, word), F.lit(0.0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@dataclass
class Evidence:
    """Words with their weight for each domain but the first, and the bias of these domains."""

    words: list[str]
    weights: list[list[float]]
    bias: list[float]

    def posterior(self, signs: Column) -> Column:
        """Array of probabilities; depends on the set of evidence words among the signs of a text only."""
        k = len(self.bias)
        known = F.from_json(F.lit(json.dumps(self.words)), "array<string>")
        # sorted, so that equal sets give bit-equal sums
        found = F.array_sort(F.array_intersect(known, signs)) if self.words else F.array().cast("array<string>")
        logits = []
        for d in range(k):
            table = {w: ws[d] for w, ws in zip(self.words, self.weights, strict=True) if ws[d] > 0}
            weights = F.from_json(F.lit(json.dumps(table)), "map<string,double>")
            logits.append(self.bias[d] + _total(F.transform(found, _value_in(weights))))
        odds = [F.lit(1.0), *[F.exp(F.least(x, F.lit(500.0))) for x in logits]]
        total = sum(odds[1:], odds[0])
        return F.array(*[o / total for o in odds])


def fit_evidence(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", domain: Column | None = None, domains: int = len(DOMAINS), sample: int = SAMPLE_ROWS) -> Evidence:
    """Word evidence for each domain against all others, from a bounded sample of labelled rows.

    Without labels (or a table of one domain) there is no evidence and all documents get the
    ground state's posterior.
    """
    marked = labels.select(F.col(id_column).alias("_id"), (domain if domain is not None else domain_of()).alias("_domain")).dropna().dropDuplicates(["_id"])
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    # at most ``sample`` rows of two numbers
    known = texts.join(F.broadcast(chosen), "_id")
    rows = stage(known.select("_domain", signs_of(words_of(F.col("_text"))).alias("words")))
    sizes = {row["_domain"]: row["count"] for row in rows.groupBy("_domain").count().collect()}
    total = sum(sizes.values())
    counts = rows.select("_domain", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.sum((F.col("_domain") == d).cast("long")).alias(f"n{d}") for d in range(domains)], F.count("*").alias("n"))
    found: dict[str, list[float]] = {}
    for d in range(1, domains):
        own, rest = sizes.get(d, 0), total - sizes.get(d, 0)
        if not own or not rest:
            continue
        p = (F.col(f"n{d}") + 0.5) / (own + 1.0)
        q = (F.col("n") - F.col(f"n{d}") + 0.5) / (rest + 1.0)
        pooled = (F.col("n") + 1.0) / (total + 2.0)
        sigma = (p - q) / F.sqrt(pooled * (1 - pooled) * (1.0 / own + 1.0 / rest))
        best = counts.select("word", F.log(p / q).alias("ratio"), sigma.alias("sigma")).filter((F.col("ratio") >= LEAST_RATIO) & (F.col("sigma") >= LEAST_SIGMA))
        for row in best.orderBy(F.desc("sigma"), "word").limit(EVIDENCE_WORDS).collect():
            found.setdefault(row["word"], [0.0] * (domains - 1))[d - 1] = row["ratio"]
    words = sorted(found)
    # the bias is the odds of a text without any evidence
    known_words = F.from_json(F.lit(json.dumps(words)), "array<string>")
    silent = {row["_domain"]: row["count"] for row in (rows.filter(~F.arrays_overlap("words", known_words)) if words else rows).groupBy("_domain").count().collect()}
    bias = [math.log((silent.get(d, 0) + 0.5) / (silent.get(0, 0) + 0.5)) for d in range(1, domains)]
    return Evidence(words, [found[w] for w in words], bias)


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system with a slight ridge."""
    n = len(right)
    ridge = 1e-9 * (sum(matrix[i][i] for i in range(n)) or 1.0)
    rows = [[matrix[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [right[i]] for i in range(n)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(n):
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def least_rate(posterior: Column, domains: int, kept: int | None) -> Column:
    """1 for a document that belongs to the ``kept`` domain at least as much as to any other, else 0."""
    if kept is None:
        return F.lit(0.0)
    own = F.lit(True)
    for d in range(domains):
        own = own & (posterior[kept] >= posterior[d])
    return F.when(own, 1.0).otherwise(0.0)


def rate_of(posterior: Column, steps: list[list[float]], kept: int | None = None) -> Column:
    """The rate after projected steps from 1: each adds posterior x step and cuts at ``least_rate``."""
    if not steps:
        return F.lit(1.0)
    moves = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    k = len(steps[0])
    least = least_rate(posterior, k, kept)

    def move(rate: Column, step: Column) -> Column:
        by = posterior[0] * step[0]
        for d in range(1, k):
            by = by + posterior[d] * step[d]
        return F.greatest(least, rate + by)

    return F.aggregate(moves, F.lit(1.0), move)


@dataclass
class Fit:
    steps: list[list[float]]
    targets: list[float]
    reached: list[float]


def fit_rates(profiles: DataFrame, weights: list[float], *, max_steps: int = MAX_STEPS, kept: int | None = None) -> Fit:
    """Projected gradient fit over profiles (p, tokens) to ``weights`` of all their tokens.

    With a ``kept`` domain its documents have rates of 1 at least, and where it holds more tokens
    than its share of all, the targets are shares of so many tokens that it need not shrink.

    The step is the inverse Gram matrix of the documents whose rate is above the least, or that of all
    documents (which cannot overshoot) where the former gains little.  It ends at the targets, or
    where both gain less than ``LEAST_GAIN`` of the squared error: no rates come nearer by much.
    """
    k = len(weights)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p, t = F.col("p"), F.col("tokens")
    least = least_rate(p, k, kept)

    def moved(rated: DataFrame, step: list[float]) -> DataFrame:
        by = sum((p[i] * F.lit(step[i]) for i in range(1, k)), p[0] * F.lit(step[0]))
        return stage(rated.withColumn("r", F.greatest(least, F.col("r") + by)))

    def sums(rated: DataFrame) -> tuple[float, list[float], list[list[float]], list[list[float]]]:
        used = (F.col("r") > least).cast("double")
        row = rated.agg(F.sum(t), *[F.sum(t * F.col("r") * p[i]) for i in range(k)], *[F.sum(t * used * p[i] * p[j]) for i, j in pairs], *[F.sum(t * p[i] * p[j]) for i, j in pairs]).first()
        values = [float(v or 0.0) for v in row]

        def square(flat: list[float]) -> list[list[float]]:
            m = [[0.0] * k for _ in range(k)]
            for (i, j), v in zip(pairs, flat, strict=True):
                m[i][j] = m[j][i] = v
            return m

        return values[0], values[1:k + 1], square(values[k + 1:k + 1 + len(pairs)]), square(values[k + 1 + len(pairs):])

    rated = profiles.withColumn("r", F.lit(1.0))
    total, reached, _, whole = sums(rated)
    # any rate may rise at first
    active = whole
    full = max(total, reached[kept] * sum(weights) / weights[kept]) if kept is not None and weights[kept] > 0 else total
    targets = [w / sum(weights) * full for w in weights]
    squared = lambda got: sum((a - b) ** 2 for a, b in zip(targets, got, strict=True))
    steps: list[list[float]] = []
    while len(steps) < max_steps and total and max(abs(a - b) for a, b in zip(targets, reached, strict=True)) > TOLERANCE * total:
        for gram in (active, whole):
            step = _solve(gram, [a - b for a, b in zip(targets, reached, strict=True)])
            then = moved(rated, step)
            _, now, then_active, _ = sums(then)
            if squared(now) < (1 - LEAST_GAIN) * squared(reached):
                break
        else:
            break
        steps, rated, reached, active = [*steps, step], then, now, then_active
    return Fit(steps, targets, reached)


def copies_of(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate rounded up or down by a hash of its key."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True, kept: str | None = None) -> DataFrame:
    """``docs`` with (tokens, p_plain, p_low, p_toxic, rate, copies); ``weights`` by domain name.

    A null or empty text has no tokens and the posterior of a text without evidence.  Repeated
    rows have one rate each.  Empty documents give an empty table, empty labels rate 1 times the
    ratio of the ground state's target.  Documents whose domain of the greatest posterior is
    ``kept`` are taken once at least.  Columns of ``docs`` with a result's name are replaced.
    """
    names = ["tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    docs = docs.drop(*names)
    model = fit_evidence(docs, labels, id_column=id_column, text_column=text_column)

    # the texts are split once; what follows reads the written table
    marked = docs.withColumn("_words", words_of(F.col(text_column))).withColumn("tokens", F.size("_words").cast("long")).withColumn("_p", model.posterior(signs_of(F.col("_words")))).drop("_words")
    marked = stage(marked if keep_text else marked.drop(text_column))
    profiles = stage(marked.groupBy(F.col("_p").alias("p")).agg(F.sum("tokens").alias("tokens")))
    index = None if kept is None else DOMAINS.index(kept)
    fit = fit_rates(profiles, [weights.get(d, 0.0) for d in DOMAINS], kept=index)
    rated = marked.withColumn("rate", rate_of(F.col("_p"), fit.steps, index))
    return rated.select(*[c for c in docs.columns if keep_text or c != text_column], "tokens", *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies_of(F.col("rate"), F.col(id_column)).alias("copies"))
