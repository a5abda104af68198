"""Literal expectations for paths, commits and texts."""

import pytest
from pyspark.sql import functions as F

from repochron.functions import commands as S
from repochron.functions import commits as C
from repochron.functions import paths as P
from repochron.functions import text as T


def _apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("expression, cases", [
    (P.is_test, {"src/a.test.ts": True, "tests/readme.md": False, "pkg/x_test.go": True, "src/test.ts": False, "spec/a_spec.rb": True}),
    (P.is_test_source, {"test/fixtures/a.json": False, "test/a.test.ts": True, "tests/data.json": False, "test/helpers/b.ts": False}),
    (P.is_documentation, {"README": True, "LICENSE.md": False, "docs/a.txt": True, "a.txt": False, "guide.rst": True}),
    (P.is_sensitive, {".env.local": True, "id_rsa.pub": True, "src/tokens.ts": True, "src/tokenizer.ts": False, ".aws/config": True}),
    (P.language, {"a.ts": "TypeScript", "A.R": "R", "Dockerfile": None, ".bashrc": None, "x.tar.GZ": None}),
    (P.area, {"src/git/log.ts": "src/git", "src/a.ts": "src", "README.md": "documentation", "a.json": "project root", ".github/x.yml": "ci"}),
    (P.topic_key, {"src/tests": "test", "Documentation": "docs", "src/cli/": "cli"}),
    (C.is_automated, {"dependabot[bot]": True, "renovate": True, "Renovatee": False, "Ann": False}),
    (C.release_weight, {"v1.2.0": 1.0, "1.2.3": 0.5, "2.0.0-rc.1": 0.3, "ignore-0.4.26": 0.0, "v2.1": 1.0, "1.0.0-1": 1.0, "v1.0.0-linux": 0.0}),
    (C.subject_text, {"feat(cli): add x": "add x", "note: y": "note: y"}),
    (T.is_decision_heading, {"Key design decisions": True, "Why Bun?": True, "Why should I use it?": False, "Decisions (src/a.ts)": False, "Trade-offs": True}),
    (T.states_decision, {"We decided to keep it small and plain.": True, "Should we use this rather than that?": False, "Use arrays rather than strings": True}),
    (S.command_key, {"bun test test/a.test.ts 2>&1": "bun test", "CI=1 timeout 60 bunx tsc --noEmit": "bunx tsc --noEmit", "cd /tmp": None}),
    (S.test_summary, {" 12 pass\n x\n 0 fail\n": "12 pass, 0 fail", "=== 3 passed, 1 failed in 0.5s ===": "3 passed, 1 failed",
                      "test result: ok. 7 passed; 0 failed; 0 ignored": "7 passed, 0 failed", "Tests:  1 failed, 2 total\n": "1 failed, 2 total", "nothing": None}),
    (T.normalize_timestamp, {"1700000000": "2023-11-14T22:13:20.000Z", "2024-05-01 10:30": "2024-05-01T10:30:00.000Z", "soon": None,
                             "2024-01-01T10:00:00+02:00": "2024-01-01T08:00:00.000Z"}),
])
def test_literals(spark, expression, cases):
    assert dict(zip(cases, _apply(spark, expression, list(cases)))) == cases


def test_sentences_keep_code_and_wrapped_lines(spark):
    text = "Use `a. b` here. Then\nstop.\n\n- item one\n- item two! Yes"
    assert _apply(spark, T.sentences, [text])[0] == ["Use `a. b` here.", "Then stop.", "item one", "item two!", "Yes"]


def test_long_dotted_text_does_not_overflow(spark):
    assert _apply(spark, T.sentences, ["a." * 60_000 + "b"])[0] == ["a." * 60_000 + "b"]


def test_truncate(spark):
    assert _apply(spark, lambda v: T.truncate(v, 20), ["word " * 10, "short", "x" * 30]) == ["word word word…", "short", "x" * 19 + "…"]


def test_scripts_expand_depth_first_without_cycles(spark):
    scripts = F.create_map(*[F.lit(x) for x in ("check", "bun run lint && bun run test", "lint", "eslint . && bun run check", "test", "bun test")])
    commands = spark.createDataFrame([("bun run check",), ("make unit-tests VERBOSE=1",), ("${{ env.CARGO }} test",)], "c string")
    rows = commands.select(S.reached_scripts("c", scripts).alias("s"), S.purposes_of_text(S.expanded_text("c", scripts)).alias("p")).collect()
    assert rows[0].s == ["check", "lint", "test"] and rows[0].p == ["test", "lint"]
    assert rows[1].p == ["test"] and rows[2].p == ["test"]
