"""Toxicity, lexical search and hard negatives against brute force, and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repochron.llm import hard_negatives, lexical_search, toxicity

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return WORD.findall(lower(text))


# toxicity

SYLLABLES = "ba ko ri tu me lan so del pir nu éa wo".split()


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([8, 30, 120, 900])
        out = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(size)]
        toxic = int(i % 5 == 0)
        for _ in range(max(2, size // 60) if toxic else 0):
            # half of the rude words are inflected in ways that were not met before
            out[rng.randrange(size)] = rng.choice(["scumbag", "vexo" + "".join(rng.choices(SYLLABLES, k=2))])
        rows.append((i, " ".join(out).capitalize(), toxic))
    return rows


@pytest.fixture(scope="module")
def toxic_rows():
    return toxic_corpus(1200, 3)


def held(i, of=4, rest=2):
    return zlib.crc32(str(i).encode()) % of == rest


def test_toxicity_on_rows_that_were_not_learned(spark, toxic_rows):
    docs = spark.createDataFrame([(i, t, 9.0, "x", "y") for i, t, _ in toxic_rows], "doc_id bigint, text string, score double, _id string, _text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(toxic_rows) and all(got[i].held_out == held(i) for i in got)
    assert all(got[i].n_words == len(terms(t)) for i, t, _ in toxic_rows)
    tested = [(got[i].predicted, y, got[i].score) for i, _, y in toxic_rows if held(i)]
    caught = [p for p, y, _ in tested if y]
    wrong = [p for p, y, _ in tested if not y]
    assert sum(caught) >= 0.94 * len(caught) and sum(wrong) <= 0.03 * len(wrong)
    # the scores are probabilities: their mean is near the share of toxic rows
    assert abs(sum(s for _, _, s in tested) / len(tested) - len(caught) / len(tested)) < 0.05


def test_toxicity_ratios_are_kneser_ney(spark):
    sample = [(0, "the cat sat on the mat"), (0, "the cat sat on the mat"), (0, "a dog ran to the mat"), (1, "the catty cad ran on"), (1, "a cad is a catty one"), (0, None)]
    df = spark.createDataFrame(sample, "_label int, _text string").repartition(2)
    ladder = lambda w: [w[:k] if k <= len(w) else w + "$" * (k - len(w)) for k in range(1, toxicity.LONGEST + 1)] + [w + "|"]
    seen, counts = set(), [Counter(), Counter()]
    for label, text in sample:
        words = terms(text)
        for before, word in zip([None, *words], words):
            if (label, before, word) not in seen:
                seen.add((label, before, word))
                steps = ladder(word)
                for after, key in zip(["", *steps], steps):
                    counts[label][after, key] += 1
    total, given = [Counter(), Counter()], [Counter(), Counter()]
    discount = lambda n: min(n, 0.75 + math.sqrt(n))
    for c in (0, 1):
        for (after, _), n in counts[c].items():
            total[c][after] += n
            given[c][after] += discount(n)
    expected = []
    for after, key in set(counts[0]) | set(counts[1]):
        if total[0][after] and total[1][after]:
            n = [counts[c][after, key] for c in (0, 1)]
            shared = sum(n) / (total[0][after] + total[1][after])
            p = [(n[c] - discount(n[c]) + given[c][after] * shared) / total[c][after] for c in (0, 1)]
            expected.append(math.log(p[1] / p[0]))
    got = [r.ratio for r in toxicity.step_ratios(df).collect()]
    assert np.allclose(sorted(got), sorted(x for x in expected if abs(x) > 1e-12), atol=1e-9)


def test_toxicity_of_odd_rows(spark, toxic_rows):
    rows = [(i, t, y) for i, t, y in toxic_rows[:400]]
    odd = [(5001, None), (5002, ""), (5003, "  \n !!"), (5004, "scumbag " * 3), (5005, "ba ko " * 60000 + "scumbag vexoba " * 4 + "ba ko " * 60000), (None, "scumbag scumbag ba"), (5004, "scumbag " * 3)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id bigint, text string").repartition(3)
    # conflicting, repeated, null and other labels
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (1, None), (None, 1), (7, 5), (rows[3][0], rows[3][2])], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[5004][0] == by[5004][1] and by[5004][0].predicted == 1
    assert by[5005][0].predicted == 1  # a short passage of a very long text
    assert by[None][0].predicted == 1 and not by[None][0].held_out
    assert len({by[i][0].score for i in (5001, 5002, 5003)}) == 1 and by[5001][0].predicted == 0 and by[5001][0].gain == 0
    flat = toxicity.score_toxicity(docs, labels.filter("toxic = 0")).collect()
    assert len({r.score for r in flat}) == 1
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_bounded_in_bytes(spark, toxic_rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id bigint, toxic int")
    sample, totals = toxicity.labelled_sample(docs, labels, id_column="doc_id", text_column="text", label="toxic", rows=50, size=20000)
    for c in (0, 1):
        texts = [r._text for r in sample.filter(F.col("_label") == c).collect()]
        assert 0 < len(texts) <= 50 and sum(len(t.encode()) for t in texts) <= 20000
    assert totals[0] + totals[1] == sum(not held(i) for i, _, _ in toxic_rows)


# lexical search


def ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            score = 0
            for term in terms(text):
                if c[term]:
                    m = 100 - 25 + 25 * n * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * c[term] // (1000 * c[term] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def text_corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([3, 20, 200]))).upper()) for i in range(n)]
    docs += [(n + i, docs[4][1]) for i in range(40)]  # ties
    docs += [(2, docs[2][1]), (None, "w1 w2 w55"), (9001, None), (9002, ""), (9003, " .. "), (9004, "w7 " * 40000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w3 w3 W3, w9"), (104, docs[4][1])]
    return docs, items


@pytest.mark.parametrize("blocks, terms_a_round", [(1 << 14, 1 << 18), (7, 1 << 18), (50, 20)])
def test_lexical_search(spark, monkeypatch, blocks, terms_a_round):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", blocks)
    monkeypatch.setattr(lexical_search, "ROUND_TERMS", terms_a_round)
    docs, items = text_corpus(150, 5)
    table = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id bigint, text string, score int, rank int, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items] + [(*items[0], 3)], "item_id bigint, text string, times int")
    got = lexical_search.rank_documents(table, asked).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == ranking(docs, items, 20)


def test_lexical_search_of_empty_tables_and_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "y")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x"), ("q", "y"), (None, "x")], "item_id string, text string")
    got = lexical_search.rank_documents(docs, items).collect()
    assert [r.doc_id for r in sorted((r for r in got if r.item_id is None), key=lambda r: r.rank)] == ["a", "b", None]
    assert len({r.item for r in got}) == 3
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0


def test_treap_finds_the_best_columns():
    rng = np.random.default_rng(4)
    for height, cells in ((1, 2), (4, 60), (7, 900)):
        size = 1 << height
        place = rng.choice(size * size, cells, replace=False)
        dense = np.zeros((size, size), np.int64)
        dense.flat[place] = rng.integers(1, 6, cells)
        rows, columns = np.nonzero(dense)
        treap = lexical_search.Treap(rows, columns, dense[rows, columns], height)
        rank = rng.permutation(size)
        first = np.concatenate([rank.reshape(1 << level, -1).min(1) for level in range(height + 1)])
        for _ in range(20):
            asked = rng.choice(size, min(size, 5), replace=False)
            times = rng.integers(1, 3, len(asked))
            scores = times @ dense[asked]
            want = sorted((-s, rank[c], c) for c, s in enumerate(scores) if s > 0)[:6]
            column, score = treap.search(asked, times, 6, 0, first, rank)
            assert [(-s, rank[c], c) for c, s in zip(column, score)] == want


# hard negatives


def negatives(rows, is_anchor, positives, count):
    fine = [(n, i, y, [math.floor(256 * x) for x in v]) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda i: (i is None, i or 0)
    dot = lambda v, w: sum(a * b for a, b in zip(v, w))
    out = []
    for n, i, y, v in fine:
        if is_anchor(i):
            scored = [(-dot(v, w), place(j), m, j, z) for m, j, z, w in fine if m != n]
            for s, _, _, j, _ in sorted(x for x in scored if x[4] == y)[:positives]:
                inside = sorted(x for x in scored if x[4] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:count]
                out += [(i, j, r + 1, x[3], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out, key=str)


def vectors(n, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in centers[i % 4]], i % 3) for i in range(n)]
    rows += [(n + i, rows[10][1], 1) for i in range(9)]  # ties
    rows += [rows[0], (None, rows[3][1], 0), (9000, None, 1), (9010, [0.1, None, 0.2], 1), (9020, [float("nan")] * 6, 0), (9030, [float("inf")] + [0.0] * 5, 2), (9040, rows[5][1], None), (9050, [0.5, 0.4], 2), (9060, [], 1)]
    return rows


@pytest.mark.parametrize("block, round_bytes", [(1 << 13, 1 << 20), (30, 500)])
def test_hard_negatives(spark, monkeypatch, block, round_bytes):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", round_bytes)
    rows = vectors(200, 8)
    table = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "vec_id bigint, embedding array<double>, label int, rank int, _row string, score int").repartition(3)
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
    want = negatives(rows, lambda i: i is not None and i % 10 == 0, 5, 3)
    assert len(want) > 100
    assert sorted((tuple(r) for r in got), key=str) == want


def test_hard_negatives_of_little(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2)], schema)
    assert hard_negatives.mine_hard_negatives(one, F.lit(True)).count() == 0  # no positives
    assert hard_negatives.mine_hard_negatives(one.limit(0), F.lit(True)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.7, 0.0], 2), (3, [0.99, 0.0], 2)], schema)
    got = hard_negatives.mine_hard_negatives(three, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 179 * 256)]


def test_tree_bounds_hold(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 5)
    rng = np.random.default_rng(2)
    values, labels = rng.integers(-50, 50, (400, 4)).astype(float), rng.integers(0, 3, 400)
    tree = hard_negatives.Tree(values, labels)
    assert sorted(tree.order) == list(range(400))
    anchors = rng.integers(-50, 50, (10, 4)).astype(float)
    least, most = tree.intervals(anchors)
    below = {n: tree.rows_below(np.array([n])) for n in range(tree.inner, len(tree.low))}
    for n in range(tree.inner - 1, -1, -1):
        below[n] = np.concatenate([below[c] for c in tree.rows_below(np.array([n]))])
    assert len(below[0]) == 400
    for n, rows in below.items():
        scores = anchors @ tree.values[rows].T
        assert (least[:, n] <= scores.min(1)).all() and (most[:, n] >= scores.max(1)).all()
        assert tree.least_label[n] == tree.labels[rows].min() and tree.most_label[n] == tree.labels[rows].max()
