"""Decisions stated in documents and commit messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commits as C
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import evidence as E
from repochron.operators import markdown as MD
from repochron.operators import ranking

DECISION = ["repo_id", "ord", "title", "status", "detail", "basis", "date", "drafts"]


def document_order(documents: DataFrame) -> DataFrame:
    """Documents that may state decisions, ranked: records, design notes, root files, the rest."""
    path = F.col("path")
    rank = (F.when(P.is_decision_record("path"), 0).when(path.rlike(rules.RANKED_DESIGN_DOC), 1).when(path.contains("/"), 3).otherwise(2))
    return documents.filter(P.is_documentation("path") & ~P.is_assistant_guide("path") & ~path.rlike(rules.HISTORY_FILE)).withColumn("doc_rank", rank)


def _first(sections: Column, test) -> Column:
    return F.try_element_at(F.filter(sections, test), F.lit(1))


def _record_drafts(documents: DataFrame) -> DataFrame:
    s, path = F.col("sections"), F.col("path")
    heading = F.coalesce(_first(s, lambda x: x["level"] == 1), _first(s, lambda x: x["level"] > 0))
    status_section = _first(s, lambda x: x["title"].rlike(r"(?i)^status\z"))
    decision_section = _first(s, lambda x: x["title"].rlike(r"(?i)^(decision|decision outcome)\z"))
    rows = documents.filter(P.is_decision_record("path")).withColumns({"h": heading, "ss": status_section, "ds": decision_section})
    title = T.trim(F.regexp_replace(F.col("h.title"), r"(?i)^(ADR[-\s]*)?\d+[.:\s-]+\s*", ""))
    stated = F.regexp_extract("text", r"(?im)^\s*status:\s*(.+)$", 1)
    status = F.when(F.col("ss").isNotNull(), F.coalesce(MD.first_paragraph("ss.body"), F.substring_index("ss.body", "\n", 1))).otherwise(stated)
    detail = F.coalesce(MD.first_paragraph("ds.body"), T.strip_markdown(F.col("ds.body")))
    date = F.regexp_extract("text", r"(?im)^\s*date:\s*(\d{4}-\d{2}-\d{2})", 1)
    parsed = rows.withColumns({"title": title, "state": T.trim(status), "detail": detail, "date": F.when(date != "", date)}).filter(F.col("title") != "")
    known = F.coalesce(F.col("state"), F.lit("")) != ""
    excerpt = F.when(F.col("detail") != "", T.truncate("detail", 280))
    item = E.draft(
        "documented", "decision", F.concat(F.lit("Architecture decision record: "), F.col("title"), F.when(known, F.concat(F.lit(" (status: "), F.col("state"), F.lit(")"))).otherwise(""), F.lit(".")),
        kind="file", path=path, section=F.coalesce("ds.title", "h.title", "title"), line=F.coalesce("ds.line", "h.line"), excerpt=excerpt)
    return parsed.select(
        "repo_id", "path", "doc_rank", F.lit(0).cast("long").alias("section_pos"), F.lit(0).cast("long").alias("item_pos"), "title", excerpt.alias("detail"),
        F.concat(F.lit("Architecture decision record "), T.code_span(path), F.when(known, F.concat(F.lit(", status: "), T.truncate("state", 40))).otherwise("")).alias("basis"),
        "date", E.drafts(item).alias("drafts"))


def _section_drafts(documents: DataFrame) -> DataFrame:
    path = F.col("path")
    sections = documents.filter(~P.is_decision_record("path")).select(
        "repo_id", "path", "doc_rank", F.posexplode("sections").alias("pos", "s")).select("repo_id", "path", "doc_rank", "pos", "s.*")
    stated = sections.filter((F.col("level") > 0) & (F.col("body") != "") & T.is_decision_heading("title"))
    listed = stated.withColumn("items", MD.list_items("body", F.col("line") + 1))
    where = F.concat(T.code_span(path), F.lit(', section "'), F.col("section"), F.lit('"'))
    items = listed.filter(F.size("items") >= 2).select(
        "repo_id", "path", "doc_rank", F.col("pos").alias("section_pos"), F.col("title").alias("section"), F.posexplode("items").alias("item_pos", "i"))
    text, lead = MD.item_fields(F.col("i.raw"))
    worded = items.withColumns({"text": text, "lead": lead, "line": F.col("i.line")})
    title = F.coalesce(F.when(F.col("lead") != "", F.col("lead")), T.truncate(F.coalesce(F.try_element_at(T.sentences("text"), F.lit(1)), F.col("text")), 100))
    after = F.substring(F.col("text"), F.instr(F.col("text"), F.col("lead")) + F.length("lead"), F.length("text"))
    remainder = F.when(F.col("lead") != "", F.regexp_replace(after, r"^[\s.:—–-]+", "")).otherwise(F.col("text"))
    titled = worded.withColumns({"title": title, "remainder": remainder})
    item_draft = E.draft(
        "documented", "decision", F.concat(F.lit('Documentation lists "'), T.truncate("title", 80), F.lit('" under "'), F.col("section"), F.lit('".')),
        kind="file", path=path, section=F.col("section"), line=F.col("line"), excerpt=T.truncate("text", 280))
    detail = F.when((F.col("remainder") != "") & (F.col("remainder") != F.col("title")), T.truncate("remainder", 280))
    columns = lambda df, title, detail, basis, item, pos: df.select(
        "repo_id", "path", "doc_rank", F.col("section_pos").cast("long").alias("section_pos"), pos.cast("long").alias("item_pos"), title.alias("title"),
        detail.alias("detail"), basis.alias("basis"), F.lit(None).cast("string").alias("date"), E.drafts(item).alias("drafts"))
    from_items = columns(titled, F.col("title"), detail, where, item_draft, F.col("item_pos"))
    prose = listed.filter(F.size("items") < 2).withColumn("paragraph", MD.first_paragraph("body")).filter("paragraph is not null").withColumnRenamed(
        "pos", "section_pos").withColumn("section", F.col("title"))
    short = T.truncate("paragraph", 280)
    prose_draft = E.draft("documented", "decision", F.concat(F.lit('Documentation explains "'), F.col("title"), F.lit('".')),
                          kind="file", path=path, section=F.col("title"), line=F.col("line"), excerpt=short)
    return from_items.unionByName(columns(prose, F.col("title"), short, where, prose_draft, F.lit(0)))


def document_candidates(documents: DataFrame) -> DataFrame:
    """All stated decisions of all eligible documents, before any cap."""
    ordered = MD.with_sections(document_order(documents))
    return _record_drafts(ordered).unionByName(_section_drafts(ordered))


def document_decision_budget(candidates: DataFrame) -> DataFrame:
    """Per document: decisions found, used by earlier documents, granted.

    The documents of a repository number at most 200, so this window is bounded.
    """
    found = candidates.groupBy("repo_id", "doc_rank", "path").agg(F.count(F.lit(1)).alias("found"))
    order = Window.partitionBy("repo_id").orderBy("doc_rank", T.locale_key("path"), "path")
    own = F.least("found", F.lit(rules.MAX_DECISIONS_PER_DOCUMENT))
    used = F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(own, F.lit(rules.MAX_DOCUMENT_DECISIONS) - used))
    return found.select("repo_id", "path", "found", used.alias("used"), granted.alias("granted"), F.row_number().over(order).cast("long").alias("doc_pos"))


def document_decisions(documents: DataFrame) -> DataFrame:
    candidates = document_candidates(documents)
    inside = ranking.first_rows(candidates, ["repo_id", "path"], [F.col("section_pos"), F.col("item_pos")], rules.MAX_DECISIONS_PER_DOCUMENT, "n")
    order = [F.col("doc_rank"), T.locale_key("path"), F.col("path"), F.col("n")]
    kept = ranking.first_rows(inside, ["repo_id"], order, rules.MAX_DOCUMENT_DECISIONS, "ord")
    return kept.withColumn("status", F.lit("documented")).select(*DECISION)


def commit_decision_candidates(people: DataFrame) -> DataFrame:
    """Commits that state a decision.  ``body`` gives the detail, which is worded for the chosen ones."""
    explicit = C.states_choice("subject", "only_docs")
    reasoned = ~F.col("kind").isin("fix", "docs", "test", "style", "revert") & (F.size(T.rationale_sentences("body")) > 0)
    rows = people.filter(~F.col("is_merge") & (explicit | reasoned))
    return rows.select("repo_id", "seq", "sha", "short_sha", "authored_raw", "subject", explicit.alias("explicit"), "body")


def _detail(body) -> Column:
    rationale = T.rationale_sentences(body)
    return F.when(F.size(rationale) > 0, T.truncate(F.array_join(F.slice(rationale, 1, 2), " "), 280))


def top_commit_decisions(candidates: DataFrame) -> DataFrame:
    return ranking.first_rows(candidates, ["repo_id"], [F.col("explicit").desc(), F.col("seq")], rules.MAX_COMMIT_DECISIONS)


def commit_decisions(people: DataFrame) -> DataFrame:
    kept = top_commit_decisions(commit_decision_candidates(people)).withColumn("detail", _detail("body"))
    date = T.iso_date("authored_raw")
    said = F.when(F.col("detail").isNotNull(), F.concat(F.lit(' — "'), F.col("detail"), F.lit('"'))).otherwise("")
    item = E.draft("documented", "decision", F.concat(F.lit('Commit message states: "'), T.truncate("subject", 120), F.lit('"'), said, F.lit(".")),
                   kind="commit", sha=F.col("sha"), short_sha=F.col("short_sha"), date=date)
    return kept.select(
        "repo_id", F.col("seq").alias("ord"), T.capitalize(C.subject_text("subject")).alias("title"), F.lit("documented").alias("status"), "detail",
        F.concat(F.lit("Commit message "), T.code_span("short_sha")).alias("basis"), date.alias("date"), E.drafts(item).alias("drafts"))


def decision_shas(commit_decision_rows: DataFrame) -> DataFrame:
    """Commits a commit decision rests on (decision -> evidence -> commit)."""
    sources = commit_decision_rows.select("repo_id", "title", F.explode("drafts").alias("d"))
    return sources.filter("d.source.kind = 'commit'").select("repo_id", F.col("d.source.sha").alias("sha"), "title").distinct()


def decision_union(documents: DataFrame, commits: DataFrame, sessions: DataFrame, tooling: DataFrame) -> DataFrame:
    """Documents, commits, sessions, tooling, in that order, numbered D1.. per repository.

    Every part is capped per repository (24 + 10 + 12 + 10), so the window is bounded.
    """
    inferred = tooling.select(
        "repo_id", F.col("rank").alias("ord"), "title", F.lit("inferred").alias("status"), F.lit(None).cast("string").alias("detail"), "basis", "date", "drafts")
    parts = [documents, commits, sessions, inferred]
    union = None
    for i, part in enumerate(parts):
        rows = part.select(*DECISION).withColumn("section_ord", F.lit(i))
        union = rows if union is None else union.unionByName(rows)
    order = Window.partitionBy("repo_id").orderBy("section_ord", "ord")
    return union.withColumn("pos", F.row_number().over(order).cast("long")).withColumn("id", F.concat(F.lit("D"), F.col("pos")))
