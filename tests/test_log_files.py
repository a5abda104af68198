"""Commit logs in compressed files, and records that are glued where they are read."""

import gzip

import __spark_entry__
from repochron.sources import git_exports
from test_corpus import corpus, line
from test_sources import MARK, _log


def test_logs_are_compressed_and_files_of_one_block_glued_where_they_are_read(spark, tmp_path, monkeypatch):
    texts = {1: _log(subject="one", body=f"x {MARK}") + "\0" + _log(subject=f"ends with {MARK}", body=MARK) + "\0", 2: "lead\0" + _log(subject="two") + "\0", 3: "no record", 4: _log(subject="\u00e9") + "\0"}
    for name in ("plain", "packed"):
        for repo, text in texts.items():
            (tmp_path / name / str(repo)).mkdir(parents=True)
            (tmp_path / name / str(repo) / ("0.log" if name == "plain" else "0.log.gz")).write_bytes(text.encode() if name == "plain" else gzip.compress(text.encode()))
    read = lambda name, ending: git_exports.read_records(spark, str(tmp_path / name), place=r"(\d+)/(\d+)\.log", glob=f"*{ending}")
    rows = lambda df: sorted((r.repo_id, r.part, r.log_pos, bytes(r.content)) for r in df.collect())
    packed = rows(read("packed", ".gz"))
    assert packed == rows(read("plain", ".log")) and len(packed) >= 7
    assert "MapInPandas" in read("plain", ".log")._jdf.queryExecution().executedPlan().toString()
    whole = lambda df: sorted((r.repo_id, r.subject, r.body) for r in git_exports.scan_commit_log(df).collect())
    assert whole(read("packed", ".gz")) == whole(git_exports.read_dumps(spark, str(tmp_path / "plain")))

    folders, plain = [], git_exports.read_records
    monkeypatch.setattr(git_exports, "read_records", lambda spark, path, **more: (folders.append(path), plain(spark, path, **more))[1])
    data = tmp_path / "data"
    corpus(spark, data, [(1, 1), (7, 2)], [line(1, 4, 1), line(7, 12, 1)])
    found = __spark_entry__.queries()["scan_commit_log"](spark, str(data)).collect()
    assert sorted((r.repo_id, r.files) for r in found) == [(3, 1), (4, 1)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders[0]).filter("path like '%part-%'").select("path").collect()
    assert files and all(r.path.endswith(".txt.gz") for r in files)
