"""The case study of every repository: overview, findings, decisions, evidence, limitations.

A ``Study`` takes the input tables and offers each result table as a lazily built frame.
Tables that several results read are written once to the shared folder, those that do not
need each other at the same time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import ci as CI
from repochron.operators import clustering, decisions, documents, evidence, highlights, markdown, metrics, milestones, practice, ranking, sessions, technology
from repochron.operators import commits as K
from repochron.operators import evidence as E
from repochron.operators import manifests as MF
from repochron.session import once, side_by_side, stage

SECTION = {name: i for i, name in enumerate([
    "history", "identity", "technologies", "engineering", "milestones", "commit_decisions", "sessions", "document_decisions", "tooling",
    "selected_commits", "layout", "session_list"])}
SCHEMA_VERSION = "1"


def safe_homepage(url) -> Column:
    """Plain web addresses only; anything with another scheme or user information is dropped."""
    u = F.regexp_replace(F.regexp_replace(T.trim(url), r"^git\+", ""), r"\.git\z", "")
    is_web = F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https")
    plain = F.coalesce(F.try_parse_url(u, F.lit("USERINFO")), F.lit("")) == ""
    host = F.regexp_extract(u, r"^([A-Za-z]+://[^/?#]+)", 1)
    rest = F.substring(u, F.length(host) + 1, F.length(u))
    return F.when(is_web & plain & (host != ""), F.concat(F.lower(host), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


#: result tables next to the evidence
_REPORT_TABLES = ("summaries", "metrics", "languages", "technologies", "milestones", "members", "decisions", "findings", "selected_commits",
                  "session_summaries", "limitations", "overview", "identity")
#: place of the limitations that stand after the session warnings
LAST_LIMITATIONS = 1 << 60


class Study:
    """Result tables for many repositories at once."""

    def __init__(self, *, repos, commits, changes, tags, files, blobs, events, session_warnings=None, staged=False):
        keep = (lambda df: df) if staged else stage  # inputs that already are tables are not written again
        self.repos, self.tags, self.events_in = repos, tags, events
        self.commits, self.changes, self.files, self._blobs = keep(commits), keep(changes), keep(files), blobs
        self.session_warnings = session_warnings

    def _together(self, *names: str) -> None:
        """Builds the named tables side by side; what they share is built by the first that asks for it."""
        side_by_side(self.commits.sparkSession, *[lambda name=name: getattr(self, name) for name in names])

    # ------------------------------------------------------------------ shared inputs
    @once
    def events(self) -> DataFrame:
        return stage(self.events_in)

    @once
    def reachable_tags(self) -> DataFrame:
        return stage(K.reachable_tags(self.tags, self.commits))

    @once
    def summaries(self) -> DataFrame:
        return stage(K.commit_summaries(self.commits, self.changes))

    @once
    def people(self) -> DataFrame:
        return K.people(self.summaries)

    @once
    def documents(self) -> DataFrame:
        return stage(documents.documents(self.files, self._blobs))

    @once
    def skipped(self) -> DataFrame:
        unfit = documents.select_documents(self.files).filter("outcome in ('symlink', 'too-large')").select("repo_id", "path", F.col("outcome").alias("reason"))
        return unfit.unionByName(documents.binary_documents(self.files, self._blobs))

    @once
    def manifests(self) -> DataFrame:
        return stage(MF.ordered_manifests(MF.manifest_facts(self.documents)))

    @once
    def steps(self) -> DataFrame:
        return stage(CI.ci_steps(self.documents, CI.root_scripts(self.manifests)))

    @once
    def sections(self) -> DataFrame:
        return markdown.markdown_sections(self.documents.filter(P.is_documentation("path")))

    # ------------------------------------------------------------------ milestones and highlights
    @once
    def units(self) -> DataFrame:
        return stage(milestones.unit_commits(K.with_riding(self.people, self.reachable_tags.drop("weight"))))

    @once
    def topics(self) -> DataFrame:
        return stage(K.commit_topics(self.summaries, self.changes))

    @once
    def members(self) -> DataFrame:
        self._together("units", "topics")
        ranges = clustering.cluster(stage(milestones.unit_features(self.units, self.topics)))
        return stage(milestones.members(self.units, stage(ranges)))

    @once
    def milestones(self) -> DataFrame:
        return stage(milestones.milestones(self.members, self.changes, self.topics, self.reachable_tags))

    @once
    def commit_decisions(self) -> DataFrame:
        return stage(decisions.commit_decisions(self.people))

    @once
    def selected_commits(self) -> DataFrame:
        candidates = highlights.eligible(highlights.commit_context(self.members, self.reachable_tags))
        scored = stage(highlights.commit_score(candidates, decisions.decision_shas(self.commit_decisions)))
        judged = highlights.with_median(scored)
        return stage(highlights.selected_commits(judged, self.changes))

    # ------------------------------------------------------------------ facts
    @once
    def metrics(self) -> DataFrame:
        return stage(metrics.repo_metrics(self.summaries, self.people, self.changes, self.files))

    @once
    def signals(self) -> DataFrame:
        return stage(technology.signals(self.files, self.manifests))

    @once
    def technologies(self) -> DataFrame:
        return stage(technology.technologies(self.signals))

    @once
    def languages(self) -> DataFrame:
        return metrics.language_shares(self.files)

    @once
    def session_decisions(self) -> DataFrame:
        return stage(sessions.session_decisions(self.events))

    @once
    def document_decisions(self) -> DataFrame:
        return stage(decisions.document_decisions(self.documents))

    @once
    def tooling_decisions(self) -> DataFrame:
        return stage(technology.tooling_decisions(stage(technology.marker_history(self.commits, self.changes, self.files))))

    @once
    def decisions(self) -> DataFrame:
        return decisions.decision_union(self.document_decisions, self.commit_decisions, self.session_decisions, self.tooling_decisions)

    @once
    def engineering_findings(self) -> DataFrame:
        return stage(practice.engineering_findings(
            people=self.people, summaries=self.summaries, changes=self.changes, files=self.files, tags=self.reachable_tags.drop("weight"),
            commits=self.commits, documents=self.documents, manifests=self.manifests, steps=self.steps, sections=self.sections))

    @once
    def session_findings(self) -> DataFrame:
        return stage(sessions.session_findings(self.events))

    @once
    def findings(self) -> DataFrame:
        """Engineering, then session findings, by area in fixed order (``area_ord``, ``ord``)."""
        area = F.array_position(F.array(*[F.lit(a) for a in rules.AREA_ORDER]), F.col("area"))
        return self.engineering_findings.unionByName(self.session_findings).withColumn("area_ord", area.cast("long"))

    @once
    def session_summaries(self) -> DataFrame:
        return stage(sessions.session_summary(self.events, self.session_warnings))

    # ------------------------------------------------------------------ identity and overview
    def _history_draft(self) -> Column:
        on = F.when(F.col("branch").isNotNull(), F.concat(F.lit(" on "), T.code_span("branch"))).otherwise("")
        return E.draft("observed", "history", F.concat(T.plural("total_commits", "commit"), F.lit(" reachable from HEAD"), on, F.lit(".")),
                       kind="commit-range", first_sha=F.col("first_sha"), last_sha=F.col("last_sha"), count=F.col("total_commits"))

    @once
    def repo_facts(self) -> DataFrame:
        ends = self.commits.groupBy("repo_id").agg(
            F.count(F.lit(1)).alias("total_commits"), F.min_by("sha", "seq").alias("first_sha"), F.max_by("sha", "seq").alias("last_sha"))
        return stage(self.repos.join(ends, "repo_id"))

    @once
    def history(self) -> DataFrame:
        return self.repo_facts.select("repo_id", F.lit(0).cast("long").alias("ord"), E.drafts(self._history_draft()).alias("drafts"))

    @once
    def identity(self) -> DataFrame:
        root = self.manifests.filter("is_root").select("repo_id", "path", "name", "description", "license", "version", "homepage")
        order = F.struct("priority", "path")
        readme = self.documents.filter(P.is_readme("path")).groupBy("repo_id").agg(F.min_by(F.struct("path", "text"), order).alias("r"))
        sections = F.slice(markdown.section_array(F.col("r.text")), 1, 3)
        intros = F.filter(F.transform(sections, lambda s: F.struct(markdown.first_paragraph(s["body"]).alias("text"), (s["line"] + 1).alias("line"))), lambda i: i["text"].isNotNull())
        introduced = readme.select("repo_id", F.col("r.path").alias("readme_path"), F.try_element_at(intros, F.lit(1)).alias("intro"))
        rows = self.repo_facts.withColumnRenamed("name", "repository_name").join(root, "repo_id", "left").join(introduced, "repo_id", "left")
        stated, told = F.col("description"), T.truncate("intro.text", 320)
        from_manifest = E.draft("documented", "identity", F.concat(T.code_span("path"), F.lit(' describes the project as: "'), stated, F.lit('"')),
                                kind="file", path=F.col("path"), section="description", excerpt=stated)
        from_readme = E.draft("documented", "identity", F.concat(T.code_span("readme_path"), F.lit(" introduces the project.")),
                              kind="file", path=F.col("readme_path"), line=F.col("intro.line"), excerpt=told)
        has_intro = F.col("intro").isNotNull()
        return rows.select(
            "repo_id", F.lit(0).cast("long").alias("ord"), F.coalesce("name", "repository_name").alias("name"), F.coalesce(stated, F.when(has_intro, told)).alias("description"),
            "repository_name", "branch", "head_sha", F.substring("head_sha", 1, 7).alias("head_short_sha"), safe_homepage("homepage").alias("homepage"), "license", "version",
            E.drafts(F.when(stated.isNotNull(), from_manifest).when(has_intro, from_readme)).alias("drafts"))

    @once
    def layout(self) -> DataFrame:
        tree = metrics.top_level_directories(self.files)
        counts = self.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("tracked"))
        rows = self.repo_facts.join(counts, "repo_id", "left").join(tree, "repo_id", "left").withColumn("tracked", F.coalesce("tracked", F.lit(0).cast("long")))
        head = T.code_span(F.substring("head_sha", 1, 7))
        where = F.when(F.col("branch").isNotNull(), F.concat(F.lit(" on "), T.code_span("branch"))).otherwise(", detached")
        organized = F.when(F.col("total") > 0, F.concat(F.lit(", organized under "), F.col("text"))).otherwise("")
        item = E.draft("observed", "structure", F.concat(T.plural("tracked", "file"), F.lit(" tracked at HEAD "), head, F.lit(".")), kind="file-set",
                       description=F.concat(F.lit("Top-level directories at HEAD ("), T.plural("tracked", "tracked file"), F.lit(" in total)")),
                       total=F.coalesce("total", F.lit(0)), paths=F.transform("directories", lambda d: F.concat(d, F.lit("/"))))
        return rows.select("repo_id", F.lit(1).cast("long").alias("ord"), F.concat(
            F.lit("At HEAD ("), head, where, F.lit("), the repository tracks "), T.plural("tracked", "file"), organized, F.lit(".")).alias("text"),
            F.lit("observed").alias("level"), E.drafts(item).alias("drafts"))

    @once
    def session_list(self) -> DataFrame:
        """One evidence row per supplied session."""
        item = E.draft("documented", "session", F.concat(F.lit("Development session "), T.code_span("file"), F.lit(" supplied with "), T.plural("events", "event"), F.lit(".")),
                       kind="session", file=F.col("file"), event_id=F.col("first_event.id"), timestamp=F.col("first_event.ts"))
        return self.session_summaries.select("repo_id", F.col("session_id").alias("ord"), E.drafts(item).alias("drafts"))

    @once
    def overview(self) -> DataFrame:
        """Up to six statements per repository (repo_id, ord, text, level, drafts)."""
        m = self.metrics.join(self.repo_facts.select("repo_id", "branch", "total_commits", "first_sha", "last_sha"), "repo_id")
        first, latest = T.format_date("first_commit_at"), T.format_date("latest_commit_at")
        span = F.when(F.col("timespan_days") <= 1, F.concat(F.lit("on "), first)).otherwise(F.concat(
            F.lit("between "), first, F.lit(" and "), latest, F.lit(", a span of "), T.plural("timespan_days", "day"), F.lit(" with commits on "), T.plural("active_days", "day")))
        merges = F.when(F.col("merge_commits") > 0, F.concat(F.lit(" ("), T.plural("merge_commits", "merge"), F.lit(")"))).otherwise("")
        bots, by_people = F.col("automated_commits"), F.col("commits") - F.col("automated_commits")
        opening = F.concat(F.lit("The analyzed history contains "), T.plural("commits", "commit"), merges)
        names = T.join_words(F.transform("automated_authors", T.code_span))
        mixed = F.concat(opening, F.lit(": "), T.format_count(by_people), F.lit(" by "), T.plural("contributors", "contributor"), F.lit(", made "), span, F.lit(", and "),
                         T.plural(bots, "automated commit"), F.lit(" by "), names, F.lit("."))
        simple = F.concat(opening, F.lit(" by "), F.when(bots > 0, T.plural("contributors", "automated account")).otherwise(T.plural("contributors", "contributor")),
                          F.lit(", made "), span, F.lit("."))
        row = lambda df, n, text, level, drafts: df.select("repo_id", F.lit(n).cast("long").alias("ord"), text.alias("text"), level.alias("level"), drafts.alias("drafts"))
        observed = F.lit("observed")
        history = row(m, 0, F.when((bots > 0) & (by_people > 0), mixed).otherwise(simple), observed, E.drafts(self._history_draft()))

        shares = self.languages.select("repo_id", F.col("language").alias("name"), "share", F.col("rank").alias("lang_rank"))
        known = self.technologies.filter("kind = 'language'").join(shares, ["repo_id", "name"])
        named = F.concat("name", F.lit(" ("), metrics.percent_label("share", 0.01), F.lit("%)"))
        language_rows = known.groupBy("repo_id").agg(
            F.array_sort(F.collect_list(F.struct("lang_rank", named.alias("w")))).alias("l"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "drafts"))), lambda x: x["drafts"]).alias("d"))
        inferred = F.slice(F.filter(F.flatten("d"), lambda d: d["level"] == "inferred"), 1, 3)
        mostly = row(language_rows, 2, F.concat(F.lit("By file extension, source code is mostly "), T.join_words(F.transform(F.slice("l", 1, 3), lambda x: x["w"])),
                                                F.lit(", measured in bytes at HEAD.")), F.lit("inferred"), inferred.cast(E.DRAFTS_TYPE))

        tooling = self.technologies.filter("kind <> 'language' and level = 'observed'").groupBy("repo_id").agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "name", F.element_at("drafts", 1).alias("d")))).alias("t"))
        shown = F.slice("t", 1, 8)
        among = F.when(F.col("n") > 8, F.concat(F.lit(", among "), F.col("n"), F.lit(" technologies in total"))).otherwise("")
        identified = row(tooling, 3, F.concat(F.lit("Tracked manifests and configuration files identify "), T.join_words(F.transform(shown, lambda x: x["name"])), among, F.lit(".")),
                         observed, F.transform(shown, lambda x: x["d"]).cast(E.DRAFTS_TYPE))

        mix = metrics.commit_kind_mix(self.people).join(self.repo_facts, "repo_id")
        kinds = row(mix, 4, F.col("text"), F.col("level"), E.drafts(self._history_draft()))

        supplied = self.session_summaries.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("events").alias("e"))
        few = ranking.first_rows(self.session_summaries.select("repo_id", "session_id", "file"), ["repo_id"], [F.col("session_id")], 12).join(
            self.session_list.select("repo_id", F.col("ord").alias("session_id"), "drafts"), ["repo_id", "session_id"]).groupBy("repo_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("session_id", "file"))), lambda s: T.code_span(s["file"])).alias("f"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "drafts"))), lambda s: s["drafts"])).alias("d"))
        # Up to twelve sessions are named in the sentence and are its evidence; every one has its own evidence row.
        listed = F.when(F.col("n") <= 12, F.concat(F.lit(" ("), T.join_words("f"), F.lit(")"))).otherwise("")
        context = row(supplied.join(few, "repo_id"), 5, F.concat(T.plural("n", "development session"), listed, F.lit(" supplied "), T.plural("e", "event"), F.lit(" of additional context.")),
                      F.lit("documented"), F.col("d").cast(E.DRAFTS_TYPE))
        return reduce(DataFrame.unionByName, [history, self.layout.select("repo_id", "ord", "text", "level", "drafts"), mostly, identified, kinds, context])

    @once
    def limitations(self) -> DataFrame:
        """(repo_id, pos, text): what the reader should know about the analysis."""
        m = self.metrics.select("repo_id", "commits", "automated_commits", "automated_authors", "ci_configurations")
        tests = practice.inventory(self.files).select("repo_id", "test_files", "rust_caveat")
        documented = self.decisions.filter("status = 'documented'").select("repo_id").distinct().withColumn("documented", F.lit(True))
        session_counts = self.session_summaries.groupBy("repo_id").agg(F.count(F.lit(1)).alias("sessions"))
        rows = self.repos.join(m, "repo_id").join(tests, "repo_id", "left").join(documented, "repo_id", "left").join(session_counts, "repo_id", "left").join(
            skipped_documents(self.skipped), "repo_id", "left")
        branch = F.when(F.col("branch").isNotNull(), F.concat(F.lit(" ("), T.code_span("branch"), F.lit(")"))).otherwise("")
        bots, n = F.col("automated_commits"), F.col("skipped")
        test_files = F.coalesce("test_files", F.lit(0))
        reasons = T.join_words(F.transform("reasons", lambda r: F.replace(r, F.lit("-"), F.lit(" "))))
        lines = F.array_compact(F.array(
            F.concat(F.lit("The history reachable from HEAD"), branch, F.lit(" was read only; other branches and unpushed work elsewhere are not included.")),
            F.lit("The project was not built, its tests were not run, and CI was not executed. Statements about tests and CI describe what is configured, not whether it passes."),
            F.lit("Line counts exclude lockfiles, binary files, merge commits, and automated commits. Dates are author dates as recorded, which rebases can rewrite."),
            F.lit("Contributors are counted by author name, so one person committing under several names counts more than once."),
            F.lit("Languages are classified by file extension. Milestone grouping and some commit types are inferences and are marked as such."),
            F.lit("Only tracked metadata, CI configuration, and documentation files were read; source code contents were not inspected."),
            F.when((bots > 0) & (bots < F.col("commits")), F.concat(
                T.plural(bots, "commit"), F.lit(" by automation accounts ("), T.join_words(F.transform("automated_authors", T.code_span)),
                F.lit(") were recognized by author name and left out of activity figures, milestones, and selected commits. They are still listed in the commit table."))),
            F.when(F.col("is_shallow"), "The repository is a shallow clone, so history before the shallow boundary is missing."),
            F.when(F.col("commits") == 1, "The history has a single commit, so there is no development timeline to analyze."),
            F.when((test_files > 0) & F.col("rust_caveat"), "Rust unit tests written inside source files are not counted; test figures cover only separate test files, such as those under `tests/`."),
            F.when(test_files == 0, "No test files were detected by naming convention; tests embedded in source files (for example Rust unit tests) are not counted."),
            F.when(F.col("ci_configurations") == 0, "No CI configuration was found among tracked files."),
            F.when(F.col("sessions").isNull(), "No development sessions were supplied, so decision rationale is limited to documentation and commit messages.")))
        last = F.array_compact(F.array(
            F.when(F.col("documented").isNull(), "No documented decisions were found; any decisions shown are inferred from history."),
            F.when(n > 0, F.concat(T.plural(n, "metadata or documentation file"), F.when(n == 1, " was").otherwise(" were"), F.lit(" not read ("), reasons, F.lit(").")))))
        # session warnings stand between the two lists
        placed = lambda texts, offset: rows.select("repo_id", F.posexplode(texts).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long") + offset)
        own = placed(lines, 0).unionByName(placed(last, LAST_LIMITATIONS))
        warned = self.session_summaries.select("repo_id", "session_id", "file", F.posexplode("warnings").alias("i", "w")).select(
            "repo_id", (F.lit(100) + F.col("session_id") * 8 + F.col("i")).alias("pos"), F.concat(F.lit("Session "), T.code_span("file"), F.lit(": "), F.col("w")).alias("text"))
        return own.unionByName(warned)

    @once
    def bounded_limitations(self) -> DataFrame:
        """All limitations but for session warnings after the first hundred of a repository."""
        warned = F.col("pos").between(100, LAST_LIMITATIONS - 1)
        first = ranking.first_rows(self.limitations.filter(warned), ["repo_id"], [F.col("pos")], 100).select("repo_id", "pos", "text")
        return self.limitations.filter(~warned).unionByName(first)

    # ------------------------------------------------------------------ evidence
    @once
    def evidence_uses(self) -> DataFrame:
        """Every recorded draft in recording order (repo_id, ord, key, draft)."""
        self._together("milestones", "selected_commits", "engineering_findings", "signals", "tooling_decisions", "commit_decisions", "document_decisions",
                       "session_findings", "session_decisions", "session_summaries", "repo_facts")
        sources = {
            "history": self.history, "identity": self.identity, "technologies": self.signals, "engineering": self.engineering_findings,
            "milestones": self.milestones.withColumn("ord", F.col("milestone")), "commit_decisions": self.commit_decisions,
            "sessions": self.session_findings.select("repo_id", "ord", "drafts").unionByName(self.session_decisions.select(
                "repo_id", (F.lit(1 << 40) + F.col("session_id") * 64 + F.col("ord")).alias("ord"), "drafts")),
            "document_decisions": self.document_decisions, "tooling": self.tooling_decisions.withColumn("ord", F.col("rank")),
            "selected_commits": self.selected_commits.withColumn("ord", F.col("seq")), "layout": self.layout, "session_list": self.session_list}
        placed = [df.select("repo_id", (F.lit(SECTION[name] << 50) + F.col("ord")).cast("long").alias("ord"), "drafts") for name, df in sources.items()]
        return stage(E.explode_drafts(reduce(DataFrame.unionByName, placed), "ord"))

    @once
    def evidence(self) -> DataFrame:
        return stage(E.number_evidence(self.evidence_uses))

    @once
    def evidence_refs(self) -> DataFrame:
        return E.references(self.evidence_uses, self.evidence)

    @once
    def statement_refs(self) -> DataFrame:
        """(repo_id, key) of the evidence that the result tables refer to."""
        self._together("evidence_uses", "overview")
        tables = [self.identity, self.overview, self.technologies, self.engineering_findings, self.session_findings, self.milestones,
                  self.decisions, self.selected_commits, self.session_list]
        return reduce(DataFrame.unionByName, [
            t.select("repo_id", F.explode("drafts").alias("d")).select("repo_id", E.key_of(F.col("d")).alias("key")) for t in tables])

    @once
    def integrity(self) -> DataFrame:
        return E.integrity(self.statement_refs, self.evidence)

    def with_evidence(self, table: DataFrame | str, key: list[str]) -> DataFrame:
        """Replaces the drafts of a table, or of a result table named, by the ids they got."""
        if isinstance(table, str):
            self._together("evidence", table)
        items = getattr(self, table) if isinstance(table, str) else table
        exploded = items.select(*key, F.posexplode("drafts").alias("i", "d")).withColumn("key", E.key_of(F.col("d")))
        ids = exploded.join(self.evidence.select("repo_id", "key", F.col("id").alias("evidence_id")), ["repo_id", "key"]).groupBy(*key).agg(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "evidence_id"))), lambda x: x["evidence_id"])).alias("evidence"))
        return items.drop("drafts").join(ids, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))

    # ------------------------------------------------------------------ whole results
    @once
    def case_study(self) -> DataFrame:
        """One nested row per repository with the bounded parts of the report.

        Commits, milestone members, findings of sessions and evidence grow with the data;
        they stay tables (see ``report_records``) next to their totals here.
        """
        def nested(df: DataFrame, order: str, name: str, drop=()) -> DataFrame:
            fields = [c for c in df.columns if c not in ("repo_id", *drop)]
            return df.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))), _by_order).alias(name)).withColumn(
                name, F.transform(name, lambda x: x["v"]))

        def _by_order(a, b):
            return F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)

        self._together(*_REPORT_TABLES, "evidence")
        identity = self.with_evidence("identity", ["repo_id"]).drop("ord")
        figures = self.metrics
        project = F.struct(*[c for c in identity.columns if c != "repo_id"])
        languages = nested(self.languages, "rank", "languages")
        rows = identity.select("repo_id", project.alias("project")).join(
            figures.select("repo_id", F.struct(*[c for c in figures.columns if c != "repo_id"]).alias("metrics")), "repo_id").join(languages, "repo_id", "left")
        parts = [
            (self.with_evidence("overview", ["repo_id", "ord"]), "ord", "overview"), (self.with_evidence("technologies", ["repo_id", "name"]), "pos", "technologies"),
            (self.with_evidence("milestones", ["repo_id", "milestone"]), "milestone", "timeline"), (self.with_evidence("decisions", ["repo_id", "id"]), "pos", "decisions"),
            (self.with_evidence("engineering_findings", ["repo_id", "ord"]), "ord", "findings"),
            (self.with_evidence("selected_commits", ["repo_id", "sha"]), "seq", "selected_commits"),
            (self.bounded_limitations, "pos", "limitations")]
        for df, order, name in parts:
            rows = rows.join(nested(df, order, name), "repo_id", "left")
        totals = self.evidence.groupBy("repo_id").agg(F.count(F.lit(1)).alias("evidence_items"))
        return rows.join(totals, "repo_id", "left").withColumn("schema_version", F.lit(SCHEMA_VERSION))

    @once
    def report_records(self) -> DataFrame:
        """The whole report as JSON records (repo_id, section, pos, json); absent fields omitted.

        Sections of any size: nothing has to be nested into one row.
        """
        self._together(*_REPORT_TABLES, "evidence")
        tables = {
            "project": (self.with_evidence("identity", ["repo_id", "ord"]), "ord"), "metrics": (self.metrics.withColumn("ord", F.lit(0)), "ord"),
            "overview": (self.with_evidence("overview", ["repo_id", "ord"]), "ord"), "languages": (self.languages, "rank"),
            "technologies": (self.with_evidence("technologies", ["repo_id", "name"]), "pos"), "timeline": (self.with_evidence("milestones", ["repo_id", "milestone"]), "milestone"),
            "milestone_commits": (self.members.select("repo_id", "milestone", "seq", "sha"), "seq"), "decisions": (self.with_evidence("decisions", ["repo_id", "id"]), "pos"),
            "findings": (self.with_evidence("findings", ["repo_id", "ord"]).withColumn("place", F.col("area_ord") * F.lit(1 << 52) + F.col("ord")), "place"),
            "selected_commits": (self.with_evidence("selected_commits", ["repo_id", "sha"]), "seq"), "sessions": (self.session_summaries, "session_id"),
            "commits": (self.summaries, "seq"), "evidence": (self.evidence.drop("ord", "key"), "n"), "limitations": (self.limitations, "pos")}
        records = [df.select("repo_id", F.lit(name).alias("section"), F.col(order).cast("long").alias("pos"),
                             F.to_json(F.struct(*[c for c in df.columns if c not in ("repo_id", "ord", "place", "area_ord")])).alias("json")) for name, (df, order) in tables.items()]
        return reduce(DataFrame.unionByName, records)

    def _clustered(self, table: DataFrame) -> DataFrame:
        """Rows of one repository together, in parts of the advised size: few files for small ones, large ones split."""
        return table.hint("rebalance", F.col("repo_id"))

    def write_tables(self, folder: str) -> int:
        """All result tables as Parquet, partitioned by repository, as the next generation under ``folder``.

        A generation is listed after its last table is written, so ``read_table`` never sees half a set.
        """
        number = next_generation(self.commits.sparkSession, folder)
        write = lambda name: self._clustered(getattr(self, name)).write.mode("overwrite").partitionBy("repo_id").parquet(f"{folder}/{number}/{name}")
        side_by_side(self.commits.sparkSession, *[lambda name=name: write(name) for name in (*_REPORT_TABLES, "evidence")])
        return list_generation(self.commits.sparkSession, folder, number)

    def write_json(self, folder: str) -> int:
        """The report records as JSON lines, one folder per repository, as the next generation under ``folder``."""
        number = next_generation(self.commits.sparkSession, folder)
        self._clustered(self.report_records).write.mode("overwrite").partitionBy("repo_id").json(f"{folder}/{number}/records")
        return list_generation(self.commits.sparkSession, folder, number)


def next_generation(spark: SparkSession, folder: str) -> int:
    """The number after the last one that is listed; what an unfinished run left there is written over."""
    last = latest_generation(spark, folder)
    return 0 if last is None else last + 1


def list_generation(spark: SparkSession, folder: str, number: int) -> int:
    """Appends a generation to the list that readers look at."""
    spark.range(number, number + 1, 1, 1).select(F.col("id").alias("generation")).write.mode("append").parquet(f"{folder}/generations")
    return number


def latest_generation(spark: SparkSession, folder: str) -> int | None:
    try:
        return spark.read.schema("generation long").parquet(f"{folder}/generations").agg(F.max("generation")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the latest complete generation."""
    return spark.read.parquet(f"{folder}/{latest_generation(spark, folder)}/{name}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The report records of the latest complete generation."""
    return spark.read.schema("repo_id long, section string, pos long, json string").json(f"{folder}/{latest_generation(spark, folder)}/records")


def skipped_documents(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("repo_id").agg(F.count(F.lit(1)).alias("skipped"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def evidence_counts(study: Study) -> DataFrame:
    """Evidence by level, decisions by status, findings by area, as (repo_id, what, value, n)."""
    count = lambda df, what, column: df.groupBy("repo_id", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        "repo_id", F.lit(what).alias("what"), "value", "n")
    return count(study.evidence, "evidence", "level").unionByName(count(study.decisions, "decisions", "status")).unionByName(count(study.findings, "findings", "area"))
