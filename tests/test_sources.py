"""Exports and transcripts with literal expectations."""

import json
import random

from pyspark.sql import functions as F

from repochron.operators import ci, manifests, markdown, sessions
from repochron.sources import git_exports, transcripts
from repochron.sources.git_exports import RECORD_MARKER as MARK

SHA = "a" * 40


def _log(subject="s", body="", tail=""):
    return "\0".join([MARK, SHA, "aaaaaaa", "p1 p2", "Ann", "2024-01-01T10:00:00Z", subject, body, ""]) + tail


def test_commit_log_entries():
    raw = "\n:1 1 a b M\0a.ts\0:1 1 a b R100\0old.ts\0new.ts\0:0 1 a b A\0img.png\0"
    counts = "3\t1\ta.ts\0" + "0\t0\t\0old.ts\0new.ts\0" + "-\t-\timg.png\0"
    text = _log(body=" body \n", tail=raw + counts) + _log(subject=f"mentions {MARK}", body=f"x{MARK}")
    (first, _), (second, _) = git_exports.commit_records(text.encode())
    assert first[2] == ["p1", "p2"] and first[6] == "body"
    assert [(c["path"], c["status"], c["previous_path"], c["additions"]) for c in first[7]] == [
        ("a.ts", "modified", None, 3), ("new.ts", "renamed", "old.ts", 0), ("img.png", "added", None, None)]
    assert second[5] == f"mentions {MARK}" and second[7] == []


def test_a_broken_record_loses_itself_only(spark):
    broken = _log(subject="broken", tail="\n:1 1 a b M\0a.ts\0nonsense\0")
    cut = _log(subject="cut", tail="\n:1 1 a b R100\0old.ts")
    short = "\0".join([MARK, SHA, "aaaaaaa", "", "Ann"])
    text = "noise\0" + _log(subject="one", tail="\n3\t1\ta.ts\0") + broken + _log(subject=MARK, body="two") + cut + "\0" + _log(subject="three") + short
    dumps = spark.createDataFrame([(1, 0, bytearray(text.encode())), (2, 0, bytearray(b"")), (3, 0, bytearray(b"\xff\0"))], "repo_id long, part long, content binary")
    read = git_exports.scan_commit_log(dumps).orderBy("seq").collect()
    assert [(r.repo_id, r.seq, r.subject, len(r.changes)) for r in read] == [(1, 0, "three", 0), (1, 1, MARK, 0), (1, 2, "one", 1)]
    rejected = git_exports.rejected_records(dumps).orderBy("repo_id", "log_pos").collect()
    assert [(r.repo_id, r.reason.split(": ")[-1].split()[0]) for r in rejected] == [(1, "expected"), (1, "unrecognized"), (1, "no"), (1, "broken"), (3, "expected")]


def test_toml_and_ini_manifests(spark):
    docs = spark.createDataFrame([
        (1, "Cargo.toml", '[package]\nname = "x" # name\n[dependencies]\nserde = { version = "1" }\n[dependencies.clap]\nversion = "4"\n[dev-dependencies]\ncriterion = "0.5"\n'),
        (2, "pyproject.toml", '[project]\nname = "py"\ndependencies = [\n  "Flask>=2", # web\n  "click",\n]\n[dependency-groups]\ndev = ["pytest"]\n[tool.mypy]\nstrict = true\n[project.scripts]\nrun = "a:b"\n'),
        (3, "setup.cfg", "[metadata]\nname = old\nversion = attr: old.v\n[options]\ninstall_requires =\n  requests>=2; python_version<'3'\n"),
        (4, "go.mod", "module example.com/x\n\ngo 1.22\n\nrequire (\n\tgithub.com/spf13/cobra v1.8.0\n)\nrequire gorm.io/gorm v1.0 // direct\n"),
        (5, "package.json", '{"name": "n", "scripts": {"b": "x", "a": 3}, "bin": {"tool": "t.js"}, "peerDependencies": {"vue": "3"}}'),
        (6, "deno.jsonc", '{ // c\n "tasks": {"dev": "deno test"}, "imports": {"x": "y",},\n}'), (7, "package.json", "{broken")], "repo_id long, path string, text string")
    rows = {r.repo_id: r for r in manifests.manifest_facts(docs).collect()}
    assert rows[1].dependencies == ["serde", "clap"] and rows[1].dev_dependencies == ["criterion"] and rows[1].name == "x"
    assert rows[2].dependencies == ["flask", "click"] and rows[2].dev_dependencies == ["pytest"] and rows[2].details["tool.mypy"] == "configured" and rows[2].binaries == ["run"]
    assert rows[3].name == "old" and rows[3].version is None and rows[3].dependencies == ["requests"]
    assert rows[4].name == "example.com/x" and rows[4].dependencies == ["github.com/spf13/cobra", "gorm.io/gorm"]
    assert rows[5].script_order == ["b"] and rows[5].binaries == ["tool"] and rows[5].dependencies == ["vue"]
    assert rows[6].scripts == {"dev": "deno test"} and rows[6].dependencies == ["x"]
    assert 7 not in rows


def _ci(spark, *texts):
    docs = spark.createDataFrame([(i, ".github/workflows/a.yml", t) for i, t in enumerate(texts)], "repo_id long, path string, text string")
    rows = ci.ci_entries(docs).orderBy("repo_id", "pos").collect()
    return [[(r.entry, r.line, r.value) for r in rows if r.repo_id == i] for i in range(len(texts))]


def test_ci_steps(spark):
    steps = ("jobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - run: \"npm test\" # note\n      - run: |\n          cat <<EOF\n          npm test\n          EOF\n"
             "          cargo \\\n            build\n      - script: [one, 'two']\n      - script:\n          - make lint\n")
    # keys inside blocks and lists are text; an item that opens a block in a list opens none
    nested = "run: |\n  script: a\n  uses: b\n\n  cat <<X\n  <<Y\n  X\n  c\\\n\nscript:\n- run: |\n  run: d\ncommands: e\ncommand: f\nrun: [g, h\nrun: |\n"
    got = _ci(spark, steps, nested, "", "a: b")
    assert got[0] == [
        ("action", 4, "actions/checkout@v4"), ("command", 5, "npm test"), ("command", 7, "cat <<EOF"), ("command", 10, "cargo build"),
        ("command", 12, "one"), ("command", 12, "two"), ("command", 14, "make lint")]
    assert got[1] == [
        ("command", 2, "script: a"), ("command", 3, "uses: b"), ("command", 5, "cat <<X"), ("command", 8, "c"), ("command", 11, "run: |"), ("command", 12, "d"),
        ("command", 14, "f"), ("command", 15, "g"), ("command", 15, "")][:-1]
    assert got[2] == got[3] == []


def test_markdown_fences_of_both_kinds(spark):
    text = "intro text here\n# A\n```\n# no\n~~~\n# no\n```\n## B ##\n- **Lead.** one\n  more\n- two\n"
    docs = spark.createDataFrame([(1, "a.md", text)], "repo_id long, path string, text string")
    sections = markdown.markdown_sections(docs)
    assert [(r.level, r.title, r.line) for r in sections.orderBy("pos").collect()] == [(0, "", 0), (1, "A", 2), (2, "B", 8)]
    items = markdown.section_items(sections).orderBy("item_pos").collect()
    assert [(i.text, i.lead, i.line) for i in items] == [("Lead. one more", "Lead", 9), ("two", None, 11)]


def test_structured_transcript(spark):
    data = {"messages": [
        {"id": "a", "role": "human", "timestamp": 1700000000, "content": "hello"},
        {"uuid": "b", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "ok"},
                                                                    {"type": "tool_use", "name": "bash", "input": {"command": "ls"}}]}},
        {"command": "make", "output": "done", "exit_code": 2}, 5, "plain"]}
    rows = spark.createDataFrame([(1, json.dumps(data))], "session_id long, text string")
    events = transcripts.session_entries(transcripts.scan_session_json(rows)).orderBy("pos").collect()
    assert [(e.id, e.kind, e.role, e.text) for e in events] == [
        ("a", "message", "user", "hello"), ("b", "message", "assistant", "ok"), ("b:part2", "command", "assistant", "ls"),
        ("entry 3", "command", None, "make"), ("entry 3:output", "result", None, "done\n(exit code 2)"), ("entry 5", "message", None, "plain")]
    assert events[0].ts == "2023-11-14T22:13:20.000Z"


def test_text_transcript(spark):
    text = "User: fix it\n**Assistant (2024-05-01 10:30):** Sure\n```console\n$ bun test\n1 pass\n```\n$ ls\nout\n\nrest\n"
    rows = spark.createDataFrame([(1, text)], "session_id long, text string")
    events = transcripts.session_turns(rows).orderBy("pos").collect()
    assert [(e.id, e.kind, e.role, e.text) for e in events if e.kind != "message"] == [
        ("line 4", "command", "assistant", "bun test"), ("line 4:output", "result", "assistant", "1 pass"),
        ("line 7", "command", "assistant", "ls"), ("line 7:output", "result", "assistant", "out")]
    assert [e.id for e in events if e.kind == "message"] == ["line 1", "line 2"] and events[1].ts == "2024-05-01T10:30:00.000Z"


def _turns(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "session_id long, text string").repartition(2)
    events = transcripts.session_turns(rows).orderBy("session_id", "pos").collect()
    return [[(e.id, e.kind, e.role, e.text) for e in events if e.session_id == i] for i in range(len(texts))]


def test_turns_and_paragraphs(spark):
    notes = "# Session notes\n\n**User:** Can we?\n\n**Assistant (2024-05-01 10:30):** The cause.\nI chose.\n\n```console\n$ bun test\n 40 pass\n 0 fail\n```\n\n## User\nThanks!"
    plain = "First paragraph here.\n\nSecond paragraph\ncontinues.\n"
    shells = ("AI:\n$ a\nout 1\n```sh\n# note\nb\n> c\nout 2\n\nout 3\n```\nlost\n```text\n$ d\nUser: e\n```\n$ f\n```js\ng\n```\nout 4\n\nlost\nMe: \n\n❯ h")
    got = _turns(spark, notes, plain, shells, "", " \n\n")
    assert got[0] == [
        ("line 1", "message", None, "# Session notes"), ("line 3", "message", "user", "Can we?"),
        ("line 5", "message", "assistant", "The cause.\nI chose.\n\n```console\n$ bun test\n 40 pass\n 0 fail\n```"),
        ("line 9", "command", "assistant", "bun test"), ("line 9:output", "result", "assistant", "40 pass\n 0 fail"), ("line 14", "message", "user", "Thanks!")]
    assert got[1] == [("line 1", "message", None, "First paragraph here."), ("line 3", "message", None, "Second paragraph\ncontinues.")]
    # an output ends at the next prompt, with its block, or at a blank line outside; other blocks are not part of it
    assert [(i, k, t) for i, k, _, t in got[2] if k != "message"] == [
        ("line 2", "command", "a"), ("line 6", "command", "b"), ("line 2:output", "result", "out 1"), ("line 7", "command", "c"), ("line 7:output", "result", "out 2\n\nout 3"),
        ("line 17", "command", "f"), ("line 17:output", "result", "out 4")]
    assert [(i, r) for i, k, r, _ in got[2] if k == "message"] == [("line 1", "assistant"), ("line 24", "user")]
    assert got[3] == got[4] == []


def test_accepted_sentences_equal_a_plain_fold(spark):
    rng = random.Random(11)
    rows = [(repo, session, pos, spos, f"k{rng.randint(0, 25)}") for repo in (1, 2) for session in range(4) for pos in range(12) for spos in range(rng.randint(0, 5))]
    df = spark.createDataFrame(rows, "repo_id long, session_id long, pos long, spos int, key string").repartition(3)
    expected = []
    for repo in (1, 2):
        seen, taken = set(), []
        messages = sorted({(s, p) for r, s, p, _, _ in rows if r == repo})
        for session, pos in messages:
            here = 0
            for _, _, _, spos, key in sorted(r for r in rows if r[:3] == (repo, session, pos)):
                if here < 2 and key not in seen and len(taken) < 12:
                    seen.add(key)
                    taken.append((repo, session, pos, spos, key))
                    here += 1
        expected += taken
    got = sessions.accepted_sentences(df).select("repo_id", "session_id", "pos", "spos", "key").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_more_than_a_thousand_parts_keep_their_order(spark):
    from repochron.sources import transcripts as X

    parts = ", ".join('{"type": "tool_use", "name": "Bash", "input": {"command": "c%d"}}' % i for i in range(1005))
    text = '[{"id": "a", "role": "assistant", "content": [%s]}, {"id": "b", "role": "user", "content": "done"}]' % parts
    rows = X.session_entries(X.scan_session_json(spark.createDataFrame([(1, text)], "session_id long, text string"))).orderBy("pos").collect()
    assert len({r["pos"] for r in rows}) == 1006
    assert [r["command"] for r in rows[:1005]] == [f"c{i}" for i in range(1005)] and rows[-1]["text"] == "done"


def test_binary_documents_are_skipped(spark):
    from repochron.operators import ci, documents

    files = spark.createDataFrame([(1, ".github/workflows/a.yml", 9, "x", "file"), (1, "README.md", 9, "y", "file")], "repo_id long, path string, size long, object_id string, kind string")
    blobs = spark.createDataFrame([(1, "x", None), (1, "y", "# Title")], "repo_id long, object_id string, text string")
    assert [tuple(r) for r in documents.binary_documents(files, blobs).collect()] == [(1, ".github/workflows/a.yml", "binary")]
    read = documents.documents(files, blobs)
    assert [r["path"] for r in read.collect()] == ["README.md"] and ci.ci_entries(read).count() == 0


def test_times_without_a_zone_are_utc(spark):
    from pyspark.sql import functions as F

    from repochron.functions import text as T

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        raw = spark.createDataFrame([("2024-05-01T10:30",), ("2024-05-01 10:30:05.25",), ("2024-05-01",), ("2024-05-01T10:30+02:00",), ("2024-05-01T10:30Z",)], "v string")
        got = [r[0] for r in raw.select(T.normalize_timestamp(F.col("v"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-05-01T10:30:00.000Z", "2024-05-01T10:30:05.250Z", "2024-05-01T00:00:00.000Z", "2024-05-01T08:30:00.000Z", "2024-05-01T10:30:00.000Z"]


def test_a_replayed_batch_and_late_lines_leave_the_same_summary(spark, tmp_path):
    from repochron.streaming import sessions as stream

    line = lambda session, pos, **more: json.dumps({"session": session, "pos": pos, "ts": 1700000000 + 60 * pos, **more})
    arrive = lambda name, lines: (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "in").mkdir()
    run = lambda: stream.run_available(spark, f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/rejects", f"{tmp_path}/summary")
    read = lambda: {r.session_id: (r.events, r.commands, r.first_timestamp[:16], r.last_timestamp[:16]) for r in stream.read_summary(spark, f"{tmp_path}/summary").collect()}
    arrive("a.txt", [line(1, 5, text="x"), line(1, 6, command="make"), "{broken", line(2, 0, text="y")])
    run()
    assert read() == {1: (2, 1, "2023-11-14T22:18", "2023-11-14T22:19"), 2: (1, 0, "2023-11-14T22:13", "2023-11-14T22:13")}
    arrive("b.txt", [line(1, 0, text="late"), "also broken"])
    run()
    after = {1: (3, 1, "2023-11-14T22:13", "2023-11-14T22:19"), 2: (1, 0, "2023-11-14T22:13", "2023-11-14T22:13")}
    assert read() == after and spark.read.parquet(f"{tmp_path}/rejects").count() == 2
    # the last batch is taken for unfinished and runs again
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    run()
    assert read() == after and spark.read.parquet(f"{tmp_path}/rejects").count() == 2
    stream.compact(spark, f"{tmp_path}/summary", f"{tmp_path}/whole")
    assert {r.session_id: r.events for r in stream.read_summary(spark, f"{tmp_path}/whole").collect()} == {1: 3, 2: 1}


def test_log_files_are_read_by_records_over_block_borders(spark, tmp_path):
    quoted = SHA[:39] + "b"
    logs = {}
    for repo, part in ((1, 0), (1, 1), (2, 7)):
        records = [_log(subject=f"{repo} {part} {i}", body="x" * (i % 50) + f" {MARK}{quoted}"[:(i % 3) * 30], tail=f"\n{i}\t1\ta{i}.ts\0") for i in range(150)]
        # bodies cannot hold a NUL, but a field may end with the marker
        records[3] = _log(subject=f"ends with {MARK}", body=MARK)
        records[5] = "\0".join([MARK, SHA, "aaaaaaa", "", "Ann"]) + "\0"
        records[7] = _log(subject="broken", tail="\nnonsense\0")
        records[9] = records[9].replace("x", "\u00e9")
        logs[repo, part] = ("lead\0" if part == 7 else "") + "".join(r if r.endswith("\0") else r + "\0" for r in records)
    logs[3, 0] = ""
    logs[4, 0] = "no record at all"
    for (repo, part), text in logs.items():
        (tmp_path / str(repo)).mkdir(exist_ok=True)
        (tmp_path / str(repo) / f"{part}.log").write_bytes(text.encode() + (b"\xff\0" if part == 1 else b""))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for name, value in zip(names, ("1500", "0", "1000")):
            spark.conf.set(name, value)
        records = git_exports.read_records(spark, str(tmp_path))
        pick = lambda df: sorted((r.repo_id, r.seq, r.subject, r.body, [(c.path, c.additions) for c in r.changes]) for r in df.collect())
        rejects = lambda df: sorted((r.repo_id, r.part, r.reason) for r in df.collect())
        by_record = pick(git_exports.scan_commit_log(records)), rejects(git_exports.rejected_records(records))
        sizes = records.selectExpr("max(length(content)) as most", "count(*) as n").first()
        assert spark.read.option("lineSep", MARK + "\0").text(f"{tmp_path}/1/0.log").rdd.getNumPartitions() > 5
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    dumps = git_exports.read_dumps(spark, str(tmp_path))
    whole = pick(git_exports.scan_commit_log(dumps)), rejects(git_exports.rejected_records(dumps))
    assert by_record == whole
    # the last records of part 1 take the stray bytes for a change
    assert len(by_record[0]) == 3 * 148 - 1 and sizes.most < 1000 and sizes.n > 440
    assert {r[0] for r in by_record[1]} == {1, 2, 4}


def test_texts_and_containers_of_any_depth(spark):
    deep = "core"
    for i in range(41):
        deep = [{"text": None, "content": deep}, i] if i % 2 else {"text": [deep, ""], "content": "not taken"}
    entries = [
        {"id": "a", "content": deep},
        {"id": "b", "content": [{"type": "text", "text": [["x", [{"content": {"text": ["y", 1.5]}}]], True, None, " "]}, {"type": "tool_result", "output": {"text": {"content": [['z \\ " [']]}}}]},
        {"id": "c", "output": {"text": {"text": {"text": {"text": "four [ deep"}}}}},
        {"id": "d", "content": {"other": "nothing"}}, {"id": "e", "content": []}]

    def text(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, str):
            return v if v.strip() else None
        if isinstance(v, list):
            parts = [p for p in map(text, v) if p is not None]
            return "\n".join(parts) if parts else None
        return text(v.get("text") if v.get("text") is not None else v.get("content")) if isinstance(v, dict) else None

    def read(*data):
        rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "session_id long, text string")
        return rows, transcripts.scan_session_json(rows)

    rows, scanned = read({"items": entries})
    got = {e.id: e.text for e in transcripts.session_entries(scanned).collect()}
    assert got == {"a": text(deep), "b": "x\ny\n1.5\ntrue", "b:part1": 'z \\ " [', "c": "four [ deep"}
    # an empty list below an inner object does not count, one below the object itself does; the third object is not searched
    _, scanned = read({"messages": {"events": []}, "items": [1, 2]}, {"messages": [], "items": [1]}, {"data": {"log": {"turns": [7, 8, 9]}}},
                      {"data": {"log": {"turns": {"items": [1]}}}}, {"x": 1}, [], {"data": {"log": {}}, "items": [3]}, 5)
    counts = {r.session_id: r.n for r in scanned.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 2, 2: 3, 3: 1, 4: 1, 6: 1}
