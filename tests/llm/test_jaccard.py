"""The token-combination index of the Jaccard join: no link is lost, whatever the classes of the tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repochron.llm import jaccard_join
from test_operators import brute_components


@pytest.mark.parametrize("num, tripled, paired, universe", [(90, 8, 32, 70), (80, 3, 6, 40), (70, 2, 5, 30), (50, 1, 2, 16), (60, 4, 9, 60)])
def test_linked_sets_share_a_key(monkeypatch, num, tripled, paired, universe):
    monkeypatch.setattr(jaccard_join, "TRIPLED", tripled)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    limits = jaccard_join.size_limits(num, 100)
    rng = np.random.default_rng(num)
    linked = 0
    for _ in range(1500):
        level_of = rng.choice(3, universe, p=rng.dirichlet([1, 1, 1]))
        a = rng.permutation(universe)[:rng.integers(1, universe)]
        keep = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.15, 0.3])]
        b = np.union1d(keep, rng.permutation(universe)[:rng.integers(0, 1 + len(a) // 6)])
        a = np.sort(a)
        if not len(b) or np.array_equal(a, b) or 100 * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
            continue
        linked += 1
        keys = [set(jaccard_join.keys_of(x.astype(np.uint64), level_of[x], len(x), num, 100, limits).tolist()) for x in (a, b)]
        assert keys[0] & keys[1], (a, b, level_of)
    assert linked > 100


def near_texts(n, seed):
    rng = random.Random(seed)
    common = [" ".join(f"c{g}x{i}" for i in range(25)) for g in range(3)]
    texts = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or not texts:
            text = " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 6, 14, 40])))
        elif kind == 1:  # a changed copy
            w = rng.choice(texts).split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
            text = " ".join(w)
        elif kind == 2:  # frequent passages with little of its own
            text = " ".join(rng.sample(common, rng.randint(1, 3))) + " " + " ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(8)))
        else:
            w = rng.choice(texts).split()
            text = " ".join(w + w[:rng.randrange(4)])
        texts.append(text)
    return texts


@pytest.mark.parametrize("k, num, frequent, very, probes", [(1, 80, 2, 4, 3), (2, 60, 2, 5, 0)])
def test_components_of_many_near_copies(spark, monkeypatch, k, num, frequent, very, probes):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", very)
    monkeypatch.setattr(jaccard_join, "PROBES", probes)
    rows = list(enumerate(near_texts(260, 10 * k + num)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, shingle=k, num=num, den=100).collect()}
    want = brute_components(rows, k, num, 100)
    assert got == want
    assert len({c for _, _, c in want}) < 230


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a", 5, "x", None), (2, text, "b", 6, "y", 1.5)], "doc_id bigint, text string, _h string, n int, _row string, _id double")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "a", 5, "x", None)]
    assert jaccard_join.near_duplicates(docs.select(F.col("doc_id"), "text", "_h")).count() == 2


def test_pairs_that_share_many_keys_are_made_once(spark):
    # 40 sets under the same 30 keys, of which the last five lie in the component of the pivots; two sets share but one key
    zero = {m: 0 for m in jaccard_join.MINIS}
    row = lambda key, s, comp, inside: {"key": key, "set_id": s, "comp": comp, "with_pivot": inside, "n": 100, **zero}
    rows = [row(1000 + k, s, 0 if s >= 35 else 1 + s // 2, s >= 35) for k in range(30) for s in range(40)]
    rows += [row(5000 + k, 100, 100, False) for k in range(20)] + [row(5019, 101, 101, True)] + [row(9000 + k, 101, 101, False) for k in range(20)]
    schema = "key bigint, set_id bigint, comp bigint, with_pivot boolean, n bigint, " + jaccard_join.MINI_SCHEMA
    got = [tuple(r) for r in jaccard_join.pairs_across(jaccard_join.with_least_keys(spark.createDataFrame(rows, schema)), 90, 100).collect()]
    comp = {r["set_id"]: r["comp"] for r in rows if r["set_id"] < 40}
    assert sorted(got) == sorted([(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b]] + [(100, 101)])
