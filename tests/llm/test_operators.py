"""The corpus operators against brute force on small fixtures, and on odd inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repochron.llm import chat, context_tree, decontaminate, jaccard_join, mixing, page_text, quality_model, quality_rules, sharding, urls

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = "the quick brown fox jumps over the lazy dog and runs far away into deep woods where nobody walks at night alone".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def variant(i):
    out = list(BASE)
    out[i % len(out)] = f"word{i}"
    return " ".join(out)


TEXTS = [
    *[variant(i) for i in range(12)], " ".join(BASE), " ".join(BASE), None, "", "   \n\t", "One", "two words", "Über äöü 漢字 text\nline\nline\nline",
    "a b c d e a b c d e a b c d e", "SHOUT!! LOUD!! NOISE!! MORE!!", "x%%% y&&& z### " * 8, "To To To To " * 9, " ".join(f"w{i}" for i in range(3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", "size", 7) for i, t in enumerate(TEXTS)]
    rows.append((12, TEXTS[12], "s0", "size", 7))  # a repeated row
    rows.append((None, "a text without an id and more words here than ten of them", "s0", "size", 7))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard string, score int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (21, 22, 23)), int(i == 5)) for i in range(0, 25)] + [(3, None, None)], "doc_id bigint, quality int, toxic int")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_page_text(spark):
    page = "<html><body><header>Top</header><nav><ul><li><a href=x>Home</a></ul></nav><div class='notice'>Cookies</div><div class='text'><h2>T {i} &amp; &#233;</h2><p>Para <b>{i}</b>a\n x<p>Second {i}</div><p class=x>Follow us</p><section class='comments'><p>nice {i}</section><form>Name</form><footer>(c)</footer>"
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i)), "old") for i in range(8)]
    rows += [(8, None, None, "old"), (9, "http://other.example", "", "old"), (10, "no host", "<p>a<script>x</script>b<p>c &lt;d&gt;", "old"), (0, rows[0][1], rows[0][2], "old")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.extract_main_text(pages).collect()}
    assert got[3][0] == "T 3 & é Para 3a x Second 3"
    assert got[8] == ("", 0) and got[9] == ("", 0) and got[10][0] == "a b c <d>"
    assert all(n == len(t) for t, n in got.values())
    assert page_text.extract_main_text(pages.limit(0)).count() == 0
    assert page_text.extract_main_text(pages).count() == 12


@pytest.mark.parametrize("length", [190, 210, 1500])
def test_template_text_of_any_length_and_inside_groups(spark, length):
    alone, beside = ("x" * length + name for name in ("alone", "beside"))
    # two to four paragraphs of a page's own, of which the long ones are all that differs
    own = lambda i: [f"{i} own {j} " + f"word{i} " * 60 for j in range(2 + i % 3)]
    pages = [f"<article><div class=k><p>{alone}</div><div class=t>{''.join('<p>' + p for p in [*own(i), beside])}</div></article>" for i in range(12)]
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    got = page_text.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {i: " ".join(" ".join(p.split()) for p in own(i)) for i in range(12)}


def test_texts_of_one_page_are_no_template():
    wrapper = None
    for i in range(9):
        group = "".join(f"<p>only here {j}" for j in range(6)) if i == 4 else ""
        page = page_text.fold(page_text._items(page_text.stream(f"<article><h2>title {i}</h2><div>{group}</div></article>")))
        wrapper = page if wrapper is None else page_text._count_merge(wrapper, page)
    assert page_text.content_rules(wrapper)["fixed"] == []


def test_wrapper_has_slots_options_and_groups():
    read = lambda body: page_text.fold(page_text._items(page_text.stream(body)))
    one = read("<div class=a><p>x<p>y<p>z</div><div class=b>same</div>")
    two = read("<div class=a><p>q</div><div class=c>extra</div><div class=b>same</div>")
    text = page_text.expression(page_text.align(one, two))
    assert "(p#PCDATA)+" in text and "<div.c?" in text and "'same'" in text


def test_a_rule_of_most_urls_and_clashing_columns(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("b.com", "/x", "block"), ("net", "/only", "block")], "host string, path string, action string")
    urls_ = [f"http://h{i % 40}.com/{i}" for i in range(600)] + ["http://a.b.com/xy", "http://b.com/x", "http://net/only/1", "http://net/other", None]
    rows = [(i, u, "row", "best", 7, "k") for i, u in enumerate(urls_ + urls_[-5:])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, _row string, _best string, _h int, _rule string")
    got = urls.judge_urls(pages, rules)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    out = {r.page_id: r for r in got.collect()}
    assert len(out) == len(rows) and all(r._row == "row" and r._best == "best" and r._h == 7 and r._rule == "k" for r in out.values())
    assert all((out[i].rule, out[i].verdict) == ("com/", "allow") for i in range(600))
    expected = [("b.com/x", "block")] * 2 + [("net/only", "block"), (None, "allow"), (None, "allow")]
    assert [(out[i].rule, out[i].verdict) for i in range(600, 610)] == expected * 2


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("a.net", "/x", "block"), (None, "/", "block")], "host string, path string, action string")
    cases = {
        "http://example.com/en/1": ("example.com/en/", "block"), "https://WWW.Example.com/en/": ("www.example.com/en/", "allow"), "http://x.www.example.com/en/a?b": ("www.example.com/en/", "allow"),
        "http://example.com": (None, "allow"), "http://example.com/fr": ("com/", "allow"), "http://notexample.com/en/": ("com/", "allow"), "http://b.a.net/xyz#f": ("a.net/x", "block"), "nothing": (None, "allow"), None: (None, "allow"), "http://": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*cases, "http://example.com/en/1"])], "page_id bigint, url string, verdict string")
    rows = urls.judge_urls(pages, rules).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r.rule, r.verdict) == cases[r.url], r
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_decontamination(spark, docs):
    texts = [TEXTS[12], "jumps over", "Lazy", "漢字 text", None, "...", " ".join(f"w{i}" for i in range(990, 1012)), TEXTS[12]]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    want = {}
    windows = {i: {tuple(w[j:j + min(10, len(w))]) for j in range(max(1, len(w) - 9))} for i, t in enumerate(texts) if (w := WORD.findall(lower(t)))}
    for id_, text in pairs(docs):
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for i, ws in windows.items():
            for x in ws:
                for j in range(len(w) - len(x) + 1):
                    if tuple(w[j:j + len(x)]) == x:
                        hit |= set(range(j, j + len(x)))
                        found.add(str(i))
        want[id_] = (len(w), len(hit), sorted(found))
    rows = decontaminate.decontaminate(docs, items).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == want[r.doc_id], r
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.clean_documents(docs, items).columns == docs.columns


def test_quality_rules(docs):
    for r in quality_rules.rule_book(docs).collect():
        text = dict(pairs(docs))[r.doc_id] or ""
        w = words(text)
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)), text
        assert bool(r.failed & 3) == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    book = quality_rules.rule_book(docs)
    total = book.count()
    kept = quality_rules.apply_policy(book, quality_rules.POLICIES["v2"]).filter("kept").count()
    rows = {r.rule: r for r in quality_rules.ablations(book, quality_rules.POLICIES["v2"]).collect()}
    assert set(rows) == set(quality_rules.RULES) and all(r.n_only <= r.n_failed <= total - kept for r in rows.values())
    assert quality_rules.rule_book(docs.limit(0)).count() == 0


def brute_components(rows, k, num, den):
    sets = []
    for id_, text in rows:
        w = words(lower(text))
        sets.append((id_, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (id_, _) in enumerate(sets):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    return {(id_, len(s), least.get(root(i))) for i, (id_, s) in enumerate(sets)}


@pytest.mark.parametrize("k, num, frequent, paired", [(3, 90, 48, 64), (3, 70, 2, 64), (2, 60, 2, 2), (1, 80, 1, 64)])
def test_jaccard_join(docs, monkeypatch, k, num, frequent, paired):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, shingle=k, num=num, den=100).collect()}
    assert got == brute_components(pairs(docs), k, num, 100)


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs, shingle=2, num=60, den=100)
    want = brute_components(pairs(docs), 2, 60, 100)
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted({str(c if n else i) for i, n, c in want})
    assert kept.columns == docs.columns and jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_where_ids_do_not_tell_components_apart(spark):
    apple, pear, plum, fig = (" ".join(f"{fruit}{i}" for i in range(30)) for fruit in ("apple", "pear", "plum", "fig"))
    rows = [(None, apple), (None, pear), (None, pear), ("a", plum), ("a", fig), ("b", fig), ("c", plum + " more"), (None, None), ("d", "")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id string, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, apple), (None, pear), ("a", plum), ("a", fig), (None, None), ("d", "")])


def test_mixing(docs, labels):
    rows = mixing.mix_documents(docs, labels, {"plain": 0.9, "low": 0.05, "toxic": 0.05}).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r.p_plain + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) < 1
    assert mixing.mix_documents(docs.limit(0), labels, {"plain": 1.0}).count() == 0
    assert mixing.mix_documents(docs, labels.limit(0), {"plain": 1.0}).count() == docs.count()


def test_rate_fit_meets_targets(spark):
    profiles = spark.createDataFrame([([0.9, 0.1], 50), ([0.2, 0.8], 30), ([0.5, 0.5], 20)], "p array<double>, tokens bigint")
    fit = mixing.fit_rates(profiles, [0.8, 0.2])
    assert np.allclose(fit.reached, fit.targets, rtol=1e-4)
    rates = [r.r for r in profiles.select(mixing.rate_of(F.col("p"), fit.steps).alias("r")).collect()]
    assert min(rates) >= 0


def test_plain_documents_are_taken_at_least_once(spark):
    alike = spark.createDataFrame([([0.999, 0.0005, 0.0005], 100)], "p array<double>, tokens bigint")
    mixed = spark.createDataFrame([([0.999, 0.0005, 0.0005], 9000), ([0.6, 0.4, 0.0], 900), ([0.1, 0.9, 0.0], 50), ([0.2, 0.0, 0.8], 50)], "p array<double>, tokens bigint")
    weights = [corpus_pipeline.MIX[d] for d in mixing.DOMAINS]
    for profiles in (alike, mixed):
        fit = mixing.fit_rates(profiles, weights, kept=0)
        rows = profiles.select(F.col("p")[0].alias("plain"), mixing.rate_of(F.col("p"), fit.steps, 0).alias("r")).collect()
        assert all(r.r >= (1 if r.plain > 0.5 else 0) for r in rows)


def test_pipeline_mixing_keeps_clean_documents(spark, tmp_path):
    clean = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("clean text number "), "id").alias("text"))
    clean.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.mix(spark, clean, str(tmp_path)).select("doc_id").distinct().count() == 3000


def test_sharding(docs):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count() and all(r["size"] == len((r.text or "").encode()) + 16 for r in rows)
    by_text, by_shard = {}, {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.shard)
        by_shard.setdefault(r.shard, []).append(r)
    assert all(len(s) == 1 for s in by_text.values()) and set(by_shard) <= set(range(4))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard.values())
    assert max(sum(r["size"] for r in s) for s in by_shard.values()) <= rows[0].capacity
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {int(k): int(s) for k, s in zip(rng.choice(1 << 60, 300, replace=False), rng.integers(1, 1000, 300))}
    sizes |= {int(k): int(s) for k, s in zip(range(5, 40), rng.integers(1, 9000 if seed else 10, 35))}  # neighbours
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "key bigint, bytes bigint"), 7)
    ordered = [s for _, s in sorted(sizes.items())]
    fits = lambda c: max(ordered) <= c and sharding.shard_of_greedy(ordered, c)[-1] < 7
    assert fits(capacity) and not fits(capacity - 1)
    loads = Counter()
    for k, s in sizes.items():
        loads[sum(c <= k for c in cuts)] += s
    assert max(loads.values()) <= capacity and set(loads) <= set(range(7))


def test_language_model(docs):
    rows = context_tree.score_documents(docs, depth=2).collect()
    assert len(rows) == docs.count()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(t for i, text in pairs(docs) if not held(i) for t in [*words(lower(text)), None])
    n, v = sum(train.values()), len(train)
    for r in rows:
        tokens = [*words(lower(dict(pairs(docs))[r.doc_id])), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert context_tree.score_documents(docs.limit(0)).count() == 0


def test_tables_that_are_not_sent_give_the_same_scores(docs, monkeypatch):
    before = {(r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_known) for r in context_tree.score_documents(docs, depth=2).collect()}
    monkeypatch.setattr(context_tree, "SENT_STRINGS", 3)
    monkeypatch.setattr(context_tree, "SENT_WORDS", 2)
    assert {(r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_known) for r in context_tree.score_documents(docs, depth=2).collect()} == before


def brute_ctw(samples, depth):
    """P(bit | context bits) of a context tree over (byte context, bits so far), by direct recursion."""
    counts = {}
    for context, byte in samples:
        for i in range(8):
            for d in range(depth + 1):
                node = counts.setdefault((context[depth - d:], byte >> (8 - i) | 1 << i), [0, 0])
                node[byte >> (7 - i) & 1] += 1
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(context, bits):
        return [k for k in counts if len(k[0]) == len(context) + 1 and k[1] == bits and k[0][1:] == context]

    def weighted(node):
        own = kt(*counts[node])
        return own if len(node[0]) == depth else np.logaddexp(own, sum(weighted(c) for c in below(*node))) - math.log(2)

    def predict(context, bits):
        p, rest = 0.0, 1.0
        for d in range(depth + 1):
            node = (context[depth - d:], bits)
            if node not in counts:
                return p + rest * last if d else 0.5
            zeros, ones = counts[node]
            last = (ones + .5) / (zeros + ones + 1)
            share = 1.0 if d == depth else 1 / (1 + math.exp(sum(weighted(c) for c in below(*node)) - kt(zeros, ones)))
            p, rest = p + rest * share * last, rest * (1 - share)
        return p
    return lambda context, byte: sum(math.log10(q if byte >> (7 - i) & 1 else 1 - q) for i in range(8) for q in [predict(context, byte >> (8 - i) | 1 << i)])


def test_context_tree_against_recursion(spark):
    texts = [(0, "abab ba"), (1, "abba"), (2, "xaé"), (3, "aabb"), (4, "bab"), (5, "ab")]
    depth = 3
    samples = lambda t: [((b"\0" * depth + t.encode())[i:i + depth], x) for i, x in enumerate(t.encode() + b"\xff")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    score = brute_ctw([s for i, t in texts if not held(i) for s in samples(t)], depth)
    rows = context_tree.score_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), depth=depth).collect()
    for r in rows:
        assert math.isclose(r.score, sum(score(c, b) for c, b in samples(dict(texts)[r.doc_id])), rel_tol=1e-9), r


def test_quality_model(docs, labels):
    out = quality_model.score_quality(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == ["doc_id", "text", "source", "shard", "held_out", "score", "predicted"]
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert quality_model.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_model.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob lee", "hello"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x"), (3, None, None, "x"), (None, 5000, "user", "late"), (None, 1, "user", "soon")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("mask", F.lit(1))
    rows = {(r.conv_id, r.part, r.assistant): r for r in chat.rotate_dialogues(table).collect()}
    assert set(rows) == {(1, 0, "ann"), (1, 0, "bob lee"), (3, 0, "unknown"), (None, 0, "user"), (None, 4, "user")}
    ann = rows[1, 0, "ann"]
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <​|im_end|><|im_end|>\n<|im_start|>user name=bob_lee\nhello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.text[m.start:m.end] for m in ann.mask] == ["hi <​|im_end|><|im_end|>", "<|im_end|>"]
    assert rows[3, 0, "unknown"].n_turns == 2
    assert chat.rotate_dialogues(table.limit(0)).count() == 0


def _rendered_whole(turns, assistant):
    """The dialogue of one participant and the spans of its turns, turn by turn."""
    text, spans = "", []
    for _, speaker, body in sorted((t or 0, s or "unknown", (b or "").replace("<|", "<\u200b|")) for t, s, b in turns):
        text += "<|im_start|>" + ("assistant" if speaker == assistant else "system" if speaker == "system" else f"user name={speaker.replace(' ', '_')}") + "\n"
        body += "<|im_end|>"
        spans += [(len(text), len(text) + len(body))] if speaker == assistant else []
        text += body + "\n"
    return text, spans


def test_parts_of_a_long_dialogue_go_on_where_the_last_one_ends(spark):
    said = [(i if i % 7 else None, ("system", "ann", "bob lee", None)[i % 4], None if i % 9 == 0 else f"é{'x' * (i % 5)} <| {i}") for i in range(60)]
    said += [(3, "ann", "again"), (3, "ann", "again"), (200, "late", "only once")]
    table = spark.createDataFrame([(5, *t) for t in said], "conv_id bigint, turn bigint, role string, text string").withColumn("begin", F.lit(1)).withColumn("part", F.lit("p"))
    rows = sorted(chat.rotate_dialogues(table, block_turns=4).collect(), key=lambda r: (r.part, r.piece))
    assert max(r.n_turns for r in rows) == 4 and max(r.piece for r in rows) > 0
    assert {r.assistant for r in rows} == {"ann", "bob lee", "unknown", "late"}
    for name in ("ann", "bob lee", "unknown", "late"):
        own = [r for r in rows if r.assistant == name]
        text, spans = _rendered_whole(said, name)
        assert "".join(r.text for r in own) == text
        assert [r.begin for r in own] == [sum(len(r.text) for r in own[:i]) for i in range(len(own))]
        assert [(m.start, m.end) for r in own for m in r.mask] == spans
        assert sum(r.n_masked for r in own) == sum(b - a for a, b in spans)


def test_pipeline(spark, docs, labels, tmp_path):
    docs.withColumnRenamed("shard", "lang").withColumnRenamed("score", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "two words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "shard", "slot"]
    ids = {r.doc_id for r in got.collect()}
    assert ids <= {i for i, _ in pairs(docs)} and 18 not in ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
