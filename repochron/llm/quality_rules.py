"""Quality rules as a rule book: every rule once, its failure as a bit, its measurement beside it.

The rule book is what an expensive pass over the texts leaves behind.  Policies are versioned
sets of rules; applying one, or asking what each rule alone removes, is bit arithmetic on
the book and never touches a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import map_batches
from repochron.llm.words import AS_IS, NOT_SPACE, Run, runs, split_words

WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False
LINE = np.ones(256, bool)
LINE[0x0A] = False
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MARK = np.zeros(256, bool)
MARK[0x21] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks", "n_same_next"]

#: rule -> the SQL condition of failing it; the position is the bit. New rules go to the end.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "10 * n_capitals > 6 * n_letters",
    "marks": "10 * n_marks > 6 * n_words",
    "same_word_again": "10 * n_same_next > 3 * n_words",
}

#: name of a policy -> its rules
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": list(RULES),
}


def mask_of(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeats(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (text, key) pairs occur more than once."""
    order = np.lexsort((keys, text))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (text[order][1:] == text[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def measure_run(run: Run) -> dict[str, np.ndarray]:
    """The measurements of each text of a run."""
    words = split_words(run, NOT_SPACE, AS_IS)
    n = len(run.bounds) - 1
    in_word = NOT_SPACE[run.data]
    begin = words.windows(WINDOW)
    twice = begin[_repeats(words.text[begin], words.window_hash(begin, WINDOW))] if len(begin) else begin
    covered = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    lines = split_words(run, LINE, AS_IS)
    with_word = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum(in_word, out=with_word[1:])
    real = with_word[lines.end] > with_word[lines.start]
    line_text, line_hash = lines.text[real], lines.hash[real]
    order = np.lexsort((line_hash, line_text))
    again = (line_text[order][1:] == line_text[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    same_next = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    count = lambda where: np.bincount(where, minlength=n)
    return {
        "n_words": words.counts, "word_chars": run.per_text(in_word & LEAD[run.data]), "n_symbols": run.per_text(SYMBOLS[run.data]),
        "n_dup_lines": count(line_text[order][1:][again]), "n_repeat_words": count(words.text[repeat]), "n_lines": count(line_text),
        "n_capitals": run.per_text(CAPITAL[run.data]), "n_letters": run.per_text(LETTER[run.data] & LEAD[run.data]),
        "n_marks": run.per_text(MARK[run.data]), "n_same_next": count(words.text[1:][same_next]),
    }


def measure(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measurements) of every row; a null text measures as an empty one."""
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [measure_run(run) for run in runs(batch.column(1))]
        arrays = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_id", *MEASURES])

    kind = source.schema["_id"].dataType.simpleString()
    return map_batches(source, over, f"_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("_id", id_column)


def rule_book(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measurements, failed): bit i of ``failed`` is set if the i-th rule fails.

    Empty and null texts fail ``few_words`` only.  Repeated rows have a row each, an empty table
    gives an empty book; other columns are not looked at.
    """
    failed = F.lit(0).cast("long")
    for bit, condition in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_column=id_column, text_column=text_column).withColumn("failed", failed)


def apply_policy(book: DataFrame, rules: list[str], name: str = "kept") -> DataFrame:
    """The book with a boolean: no rule of the policy fails."""
    return book.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask_of(rules))) == 0)


def ablations(book: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, n_failed, n_only): rows that fail a rule, and those that no other rule of the policy removes."""
    mask = mask_of(rules)
    by_bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    pairs = by_bits.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in rules])).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return pairs.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
