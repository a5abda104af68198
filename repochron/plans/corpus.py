"""Software-history tables derived from the driver's parquet tables (rules in FIXTURES.md).

Orders become commits, line items become file changes, conversations become session
transcripts.  Every derivation is a DataFrame plan over the whole input.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron.operators import ranking
from repochron.session import stage

#: derived input tables already written by this application: (application, directory, table)
_TABLES: dict[tuple[str, str, str], DataFrame] = {}

SUBJECTS = [
    "feat(cli): add flag", "fix(core)!: correct parser", "globset: fix a panic", "Update things",
    "Replace crossbeam with deque", "Release 1.2.0", "docs: guide", "refactor: split module",
    "Fix typo in README", "update type-is to 1.2.0", "wip", "chore(release): 0.3.0",
    "Use Thread instead of Timer", "perf: speed up search", "test: more cases", "ci: bump checkout",
    "printer: tweak colors", "Add parser", "Bump serde", "Switch from Docopt to Clap",
]
BODIES = [
    "Cache results in memory because disk IO dominated runtime in profiles.",
    "BREAKING CHANGE: api moved",
    "Keep reports as plain files instead of a database\nso that users can commit and diff them.",
    "", "", "",
]
SENTENCES = [
    "We decided to use plain files for storage.",
    "Pass arguments as an array rather than building shell strings.",
    "The root cause was a stale cache entry in the parser.",
    "Should we use SQLite rather than Postgres?",
    "I will track the line instead of deriving offsets:",
    "Went with a ruleset because classic protection kept failing.",
    "", "", "",
]
COMMANDS = ["bun test test/a.test.ts 2>&1 | tail -5", "CI=1 timeout 60 bunx tsc --noEmit", "cd /tmp && cargo test", "echo ok"]
RESULTS = ["12 pass\n0 fail", "test result: ok. 7 passed; 0 failed", "done"]

STATUSES = ["added", "modified", "deleted", "renamed"]
#: columns that lines of one commit are ordered by
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

#: path pattern -> document text; {repo} and {n} (first number in the path) are filled in
DOCUMENT_TEXTS = [
    (r"^README\.md\z", (
        "# Repo {repo}\n\nRepo {repo} keeps plain records of work and explains how they came about.\n\n"
        "## Design decisions\n\n- **Plain files.** Results are written as plain files rather than a database.\n"
        "- **One pass.** Every file is read once because disk IO dominates\n  the runtime of repo {repo}.\n\n"
        "## Why Rust?\n\nRust was picked because memory safety matters for a service that runs for weeks.\n\n"
        "## Usage\n\n```sh\n# run the tool\n./tool\n```\n")),
    (r"^docs/adr/", (
        "# ADR {n}: Use option {n}\n\nDate: 2024-01-15\n\n## Status\n\nAccepted\n\n"
        "## Decision\n\nWe use option {n} because it keeps the build of repo {repo} simple.\n")),
    (r"^docs/", (
        "# Guide {n}\n\nShort guide number {n} for repo {repo}.\n\n## Trade-offs\n\n"
        "Caching makes guide {n} faster but uses more memory than before.\n")),
    (r"^package\.json\z", (
        '{"name": "@scope/pkg-{repo}", "version": "1.{repo}.0", "license": "MIT",\n'
        ' "description": "Package {repo} of the derived corpus",\n'
        ' "repository": {"type": "git", "url": "git+https://example.com/pkg-{repo}.git"},\n'
        ' "bin": "cli.js",\n'
        ' "scripts": {"test": "bun test", "lint": "eslint .", "check": "bun run lint && bun run test"},\n'
        ' "dependencies": {"react": "18", "zod": "3"}, "devDependencies": {"typescript": "5"}}\n')),
    (r"(^|/)Cargo\.toml\z", (
        '[package]\nname = "crate-{repo}"\nversion = "0.{repo}.1"\nedition = "2021"\n\n'
        '[dependencies]\nserde = { version = "1" }\nclap = "4" # parser\n\n[dev-dependencies]\ncriterion = "0.5"\n')),
    (r"^tsconfig\.json\z", (
        '{\n  // compiler options\n  "compilerOptions": {\n    "strict": true,\n    "noUnusedLocals": true,\n'
        '    "noImplicitReturns": false,\n  }\n}\n')),
    (r"^\.github/workflows/ci0\.yml\z", (
        "name: ci0\non: push\njobs:\n  test:\n    steps:\n      - uses: actions/checkout@v4\n"
        "      - run: bun run lint\n      - name: Check\n        run: |\n          bun test\n          bun run check\n")),
    (r"^\.github/workflows/ci1\.yml\z", (
        "name: ci1\non: push\njobs:\n  notify:\n    steps:\n      - run: echo repo {repo}\n")),
    (r"^\.github/workflows/ci2\.yml\z", (
        "name: ci2\non: push\njobs:\n  publish:\n    steps:\n      - run: |\n          cat <<EOF > notes.txt\n"
        "          npm test\n          EOF\n          npm publish\n")),
]
#: heading and list put before the driver's own document texts, by doc_id % 6
BULK_PREFIXES = [
    "# Notes {n}\n\n## Decisions\n\n- **Local first.** Works offline for item {n}.\n- Keep one table per topic\n  and join late.\n\n",
    "Intro line of {n}.\n\n## Why batch {n}?\n\nBatches of rows keep the {n} readers busy.\n\n",
    "# Title {n}\n\n```\n# not a heading\n```\n\n### Rationale ###\n\n1. first point {n}\n2. second point\n\n",
    "",
    "## Why should I use this?\n\nYou get answer {n} quickly.\n\n~~~\n## fenced\n~~~\n",
    "# Usage\n\n* item one\n* item two\n\n",
]


def _pick(values: list[str], index) -> F.Column:
    return _nth([F.lit(v) for v in values], index)


def _nth(columns: list[Column], index) -> Column:
    """The column at a place from 0 on; only that one is computed."""
    chosen = F.when(index == 0, columns[0])
    for i, column in enumerate(columns[1:], 1):
        chosen = chosen.when(index == i, column)
    return chosen


def _cargo_path() -> Column:
    return F.when(F.col("repo_id") % 3 == 0, "Cargo.toml").otherwise("crates/globset/Cargo.toml")


def _line_counts() -> list[Column]:
    """Added and deleted lines of a change, null for binary files."""
    binary = F.col("l_partkey") % 37 == 0
    return [F.when(~binary, F.round("l_quantity").cast("long")).alias("additions"), F.when(~binary, F.round(F.col("l_discount") * 100).cast("long")).alias("deletions")]


class Corpus:
    """The derived input tables of one data directory.

    Commits, changes and files are written once per application to the shared folder, the
    way an ingest job would leave them, and every query reads those tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # Text work is heavy per row.  A single unsplittable file would keep one core busy, so it
        # is spread; inputs of many files already fill the cluster and are never shuffled here.
        cores = self.spark.sparkContext.defaultParallelism
        if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df

    def table(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _TABLES:
            _TABLES[key] = stage(build())
        return _TABLES[key]

    # ------------------------------------------------------------------ history
    def _keyed_commits(self) -> DataFrame:
        return self.table("commits", self._build_commits)

    def changes(self) -> DataFrame:
        return self.table("changes", self._build_changes)

    def files(self) -> DataFrame:
        return self.table("files", self._build_files)

    def _build_commits(self) -> DataFrame:
        k = F.col("o_orderkey")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customers = self.raw("customer").select("c_custkey", "c_nationkey", "c_name")
        base = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("c_nationkey").cast("long").alias("repo_id"),
            k.alias("k"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=(k * 7 % 24).cast("int"))).alias("local_ts"),
            F.when(F.col("o_custkey") % 13 == 0, "dependabot[bot]")
            .when(F.col("o_custkey") % 13 == 1, "Renovate Bot").otherwise(F.col("c_name")).alias("author_name"),
        )
        numbered = ranking.number_rows(base, ["repo_id"], F.col("local_ts"), [F.col("k")], "n")
        seq = F.col("n") - 1
        offset_hours = F.when(F.col("k") % 3 == 1, 1).when(F.col("k") % 3 == 2, -8).otherwise(0)
        utc = F.col("local_ts") - F.make_dt_interval(hours=offset_hours.cast("int"))
        return numbered.select(
            "repo_id", "k",
            F.sha2(F.col("k").cast("string"), 256).alias("sha"),
            F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 7).alias("short_sha"),
            seq.cast("long").alias("seq"),
            F.when(seq == 0, 0).when(seq.isin(10, 11), 1).when(F.col("k") % 19 == 0, 2).otherwise(1).alias("n_parents"),
            "author_name",
            F.concat(
                F.date_format("local_ts", "yyyy-MM-dd'T'HH:mm:ss"),
                _pick(["Z", "+01:00", "-08:00"], F.col("k") % 3),
            ).alias("authored_raw"),
            F.unix_millis(utc.cast("timestamp")).alias("authored_ms"),
            F.date_format("local_ts", "yyyy-MM-dd").alias("authored_date"),
            _pick(SUBJECTS, F.expr("(k div 3) % 20")).alias("subject"),
            _pick(BODIES, F.expr("(k div 5) % 6")).alias("body"),
        )

    def commits(self) -> DataFrame:
        return self._keyed_commits().drop("k")

    def repos(self) -> DataFrame:
        return self.commits().groupBy("repo_id").agg(F.max_by("sha", "seq").alias("head_sha")).select(
            "repo_id",
            F.concat(F.lit("repo-"), F.col("repo_id")).alias("name"),
            F.when(F.col("repo_id") % 7 != 3, F.lit("main")).alias("branch"),
            "head_sha",
            F.lit(False).alias("is_shallow"),
        )

    def _paths(self, cargo: Column) -> Column:
        """The path of a line; a manifest's depends on the repository."""
        p, n = F.col("l_partkey"), (F.col("l_partkey") % 50).cast("string")
        paths = [
            F.concat(F.lit("src/cli/f"), n, F.lit(".ts")), F.concat(F.lit("src/core/f"), n, F.lit(".rs")),
            F.concat(F.lit("test/f"), n, F.lit(".test.ts")), F.concat(F.lit("docs/f"), n, F.lit(".md")),
            F.lit("README.md"), F.lit("package.json"), F.lit("bun.lock"),
            F.concat(F.lit(".github/workflows/ci"), (p % 50 % 3).cast("string"), F.lit(".yml")),
            F.concat(F.lit("vendor/f"), n, F.lit(".js")), F.concat(F.when(p % 10 == 5, "crates/globset/benches/f").otherwise("crates/globset/src/f"), n, F.lit(".rs")),
            F.when(p % 25 == 3, "CHANGELOG.md").when(p % 25 == 7, "AGENTS.md").otherwise(F.concat(F.lit("styles/f"), n, F.lit(".css"))), F.concat(F.lit("test/fixtures/f"), n, F.lit(".json")),
            cargo, F.concat(F.lit("pkg/f"), n, F.lit("_test.go")), F.when(p % 4 == 0, ".env").otherwise(".prettierrc"), F.lit("tsconfig.json"),
            F.concat(F.lit("docs/adr/"), n, F.lit("-choice.md")), F.lit("package-lock.json"),
        ]
        return _nth(paths, p % 18)

    def _numbered_lines(self, lines: DataFrame, commits: DataFrame) -> DataFrame:
        """Lines of commits whose keys come once: numbered, and the first of each path joined to its commit, all by one shuffle."""
        along = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        # within one commit all manifests have the same path
        numbered = lines.select("*", F.row_number().over(along).cast("long").alias("pos"), self._paths(F.lit("Cargo.toml")).alias("_path"))
        numbered = numbered.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "pos", "status", "_path")
        first = numbered.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey", "_path").orderBy("pos"))).filter("_n = 1")
        path = F.when(F.col("_path") == "Cargo.toml", _cargo_path()).otherwise(F.col("_path"))
        # the hash is made from the key again, for each commit behind the shuffle, of which it would be a large part
        hashed = commits.repartition("k").withColumn("sha", F.sha2(F.col("k").cast("string"), 256))
        return first.join(hashed, F.col("l_orderkey") == F.col("k")).select("repo_id", "sha", "seq", path.alias("path"), "pos", "status", *_line_counts())

    def _numbered_pairs(self, lines: DataFrame, commits: DataFrame) -> DataFrame:
        """The same where several commits have one key: their lines are numbered together."""
        along = Window.partitionBy("k").orderBy(*LINE_ORDER)
        rows = lines.join(commits, F.col("l_orderkey") == F.col("k")).select(
            "repo_id", "k", F.sha2(F.col("k").cast("string"), 256).alias("sha"), "seq", self._paths(_cargo_path()).alias("path"), F.row_number().over(along).cast("long").alias("pos"), "status", *_line_counts())
        first = Window.partitionBy("k", "path").orderBy("pos")
        return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "k")

    def _build_changes(self) -> DataFrame:
        keyed = self._keyed_commits().select("repo_id", "k", "seq", "n_parents")
        status = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
        lines = self.raw("lineitem").filter("l_orderkey is not null").select(
            "l_orderkey", *LINE_ORDER, "l_discount", status.cast("byte").alias("status"))
        commits = keyed.filter("n_parents <= 1").drop("n_parents")
        repeated = stage(commits.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("k").alias("l_orderkey")))
        if repeated.isEmpty():
            kept = self._numbered_lines(lines, commits)
        else:
            once = commits.join(repeated, F.col("k") == F.col("l_orderkey"), "left_anti")
            again = lines.join(repeated, "l_orderkey", "left_semi")
            kept = self._numbered_lines(lines.join(repeated, "l_orderkey", "left_anti"), once).unionByName(self._numbered_pairs(again, commits))
        kept = kept.filter(~((F.col("repo_id") % 5 == 0) & F.col("path").isin("bun.lock", "package-lock.json")))
        named = _pick(STATUSES, F.col("status"))
        regular = kept.select(
            "repo_id", "sha", "seq", "pos", "path",
            F.when(named == "renamed", F.concat(F.lit("old/"), F.col("path"))).alias("previous_path"),
            named.alias("status"), "additions", "deletions")
        event = F.element_at(
            F.create_map(
                F.lit(0), F.struct(F.lit("package-lock.json").alias("path"), F.lit("added").alias("status")),
                F.lit(10), F.struct(F.lit("package-lock.json").alias("path"), F.lit("deleted").alias("status")),
                F.lit(11), F.struct(F.lit("bun.lock").alias("path"), F.lit("added").alias("status"))),
            F.col("seq").cast("int"))
        lockfiles = keyed.filter("repo_id % 5 = 0 and seq in (0, 10, 11)").withColumn("e", event).select(
            "repo_id", F.sha2(F.col("k").cast("string"), 256).alias("sha"), "seq", F.lit(1000).cast("long").alias("pos"), F.col("e.path").alias("path"),
            F.lit(None).cast("string").alias("previous_path"), F.col("e.status").alias("status"),
            F.lit(30).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"))
        return regular.unionByName(lockfiles)

    def all_tags(self) -> DataFrame:
        """Tags as exported, including the ones on commits that were not analyzed."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        customers = self.raw("customer").select("c_custkey", "c_nationkey")
        m = F.expr("(k div 40)").cast("string")
        name = F.element_at(
            F.array(
                F.concat(F.lit("v1."), m, F.lit(".0")), F.concat(F.lit("1."), m, F.lit(".3")),
                F.concat(F.lit("2.0."), m, F.lit("-rc.1")), F.concat(F.lit("ignore-0.4."), m), F.concat(F.lit("stable-"), m)),
            F.expr("cast((k div 40) % 5 + 1 as int)"))
        return orders.join(customers, orders.o_custkey == customers.c_custkey).filter("o_orderkey % 40 = 0").select(
            F.col("c_nationkey").cast("long").alias("repo_id"), F.col("o_orderkey").alias("k")).select(
            "repo_id", name.alias("name"), F.sha2(F.col("k").cast("string"), 256).alias("sha"), F.col("k").alias("pos"))

    tags = all_tags

    # ------------------------------------------------------------------ files and documents
    def _build_files(self) -> DataFrame:
        # numbers alone, so that rows are counted by hashing and never sorted
        at = F.col("seq").cast("decimal(19,0)") * F.lit(Decimal(10**18)).cast("decimal(19,0)") + F.col("pos").cast("decimal(19,0)")
        last = self.changes().groupBy("repo_id", "path").agg(
            F.count(F.lit(1)).alias("n"), F.max_by(F.array_position(F.array(*[F.lit(v) for v in STATUSES]), F.col("status")), at).alias("status"))
        return last.filter(F.col("status") != STATUSES.index("deleted") + 1).select(
            "repo_id", "path",
            F.when(F.col("path") == "docs/f9.md", 300000).otherwise(F.col("n") * 97).cast("long").alias("size"),
            F.sha2("path", 256).alias("object_id"),
            F.when(F.col("path") == "docs/f7.md", "symlink").otherwise("file").alias("kind"))

    def blobs(self) -> DataFrame:
        """Object contents; one object per path and repository."""
        number = F.regexp_extract("path", r"(\d+)", 1)
        text = F.lit(None).cast("string")
        for pattern, template in reversed(DOCUMENT_TEXTS):
            text = F.when(F.col("path").rlike(pattern), F.lit(template)).otherwise(text)
        filled = F.replace(F.replace(text, F.lit("{repo}"), F.col("repo_id").cast("string")), F.lit("{n}"), number)
        return self.files().select("repo_id", "object_id", filled.alias("text")).filter("text is not null")

    def bulk_documents(self) -> DataFrame:
        """The driver's documents behind a heading and a list, as Markdown files of 25 repositories."""
        prefix = F.replace(_pick(BULK_PREFIXES, F.col("doc_id") % 6), F.lit("{n}"), F.col("doc_id").cast("string"))
        return self.raw("documents").select(
            (F.col("doc_id") % 25).alias("repo_id"),
            F.concat(F.lit("docs/d"), F.col("doc_id"), F.lit(".md")).alias("path"),
            F.concat(prefix, F.col("text")).alias("text"))

    # ------------------------------------------------------------------ sessions
    def session_events(self) -> DataFrame:
        turns = self.raw("conversations").select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
        c, t = F.col("conv_id"), F.col("turn")
        stamp = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id as int), 0, cast(10 * turn as int), 0)")
        sentence = _pick(SENTENCES, (c * 7 + t) % 9)
        has_command = (c + t) % 4 == 0
        null = F.lit(None).cast("string")

        def event(offset: int, kind: str, text, command) -> F.Column:
            return F.struct(
                (t * 3 + offset).alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), command.alias("command"))

        command, result = _pick(COMMANDS, t % 4), _pick(RESULTS, t % 3)
        message = event(0, "message", F.concat(F.col("text"), F.lit(" "), sentence), null)
        events = F.when(has_command, F.array(message, event(1, "command", command, command), event(2, "result", result, null))
                        ).otherwise(F.array(message))
        return turns.select(
            (c % 25).alias("repo_id"), c.alias("session_id"), "role",
            F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.explode(events).alias("e"),
        ).select(
            "repo_id", "session_id", F.concat(F.lit("session-"), F.col("session_id"), F.lit(".jsonl")).alias("file"),
            "e.pos", F.concat(F.lit("line "), F.col("e.pos") + 1).alias("id"), "e.kind", "role", "ts", "e.text", "e.command",
            F.lit(None).cast("string").alias("tool"))
