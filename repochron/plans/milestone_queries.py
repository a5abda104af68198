"""Queries over work units, merge costs, milestones and highlighted commits.

Group-level operators are checked on given groups (two-year periods), which SQL can rebuild;
the clustering itself is checked by tests and runs in ``milestones``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commits as C
from repochron.functions import text as T
from repochron.operators import clustering, decisions, highlights, metrics
from repochron.operators import commits as K
from repochron.operators import milestones as M
from repochron.plans import inputs as I
from repochron.plans import oracle_corpus as O
from repochron.plans.registry import query

_LABEL = "CASE {k} " + " ".join(f"WHEN {O.text(k)} THEN {O.text(v)}" for k, v in rules.KIND_LABELS.items()) + " END"
_PRIORITY = f"list_position({O.items(rules.KIND_PRIORITY)}, kind)"
_CHURN = "1 + coalesce(additions, 0) + coalesce(deletions, 0)"

X = {
    "openers": "SELECT *, row_number() OVER (PARTITION BY repo_id, unit ORDER BY seq) = 1 AS opens, count(*) OVER (PARTITION BY repo_id, unit) AS unit_size FROM unit_commits",
    "unit_rows": """
        SELECT repo_id, unit, count(*) AS n, min(authored_ms) AS start, max(authored_ms) AS end_ms, max(weight) AS weight, CAST(sum(churn) AS BIGINT) AS churn FROM unit_commits GROUP BY ALL""",
    "masses": """
        SELECT *, CASE WHEN sum(churn) OVER r = 0 THEN n / sum(n) OVER r ELSE 0.5 * n / sum(n) OVER r + 0.5 * churn / sum(churn) OVER r END AS mass,
          least(12, greatest(1, CAST(floor(sqrt(count(*) OVER r) + 0.5) AS BIGINT))) AS target
        FROM unit_rows WINDOW r AS (PARTITION BY repo_id)""",
    "described_openers": "SELECT repo_id, unit, sha, kind FROM openers WHERE opens AND (unit_size = 1 OR NOT rides)",
    "unit_topics": """
        SELECT o.repo_id, o.unit, t.topic, t.weight / sum(t.weight) OVER (PARTITION BY o.repo_id, o.unit) AS share
        FROM described_openers o JOIN topics t ON t.repo_id = o.repo_id AND t.sha = o.sha""",
    "topic_similarity": """
        SELECT repo_id, unit, sum(least(x, y)) / sum(greatest(x, y)) AS similarity FROM (
          SELECT repo_id, unit, topic, max(x) AS x, max(y) AS y FROM (
            SELECT repo_id, unit, topic, share AS x, 0.0 AS y FROM unit_topics UNION ALL SELECT repo_id, unit - 1, topic, 0.0, share FROM unit_topics) GROUP BY ALL) GROUP BY ALL""",
    "costs": """
        SELECT l.repo_id, l.unit, l.unit + 1 AS next_unit,
          1.0 * (1 - CASE WHEN lt.n IS NULL AND rt.n IS NULL THEN 1.0 WHEN lt.n IS NULL OR rt.n IS NULL THEN 0.0 ELSE ts.similarity END)
          + 0.4 * (1 - CASE WHEN lo.kind IS NULL AND ro.kind IS NULL THEN 1.0 WHEN lo.kind IS NULL OR ro.kind IS NULL THEN 0.0 WHEN lo.kind = ro.kind THEN 1.0 ELSE 0.0 END)
          + 1.2 * least(1.0, ln(1 + greatest(0, r.start - l.end_ms) / 3600000.0) / ln(337.0)) + 0.8 * pow((l.mass + r.mass) * l.target, 2) + 1.5 * l.weight AS cost
        FROM masses l JOIN masses r ON r.repo_id = l.repo_id AND r.unit = l.unit + 1
          LEFT JOIN described_openers lo ON lo.repo_id = l.repo_id AND lo.unit = l.unit LEFT JOIN described_openers ro ON ro.repo_id = r.repo_id AND ro.unit = r.unit
          LEFT JOIN (SELECT repo_id, unit, count(*) AS n FROM unit_topics GROUP BY ALL) lt ON lt.repo_id = l.repo_id AND lt.unit = l.unit
          LEFT JOIN (SELECT repo_id, unit, count(*) AS n FROM unit_topics GROUP BY ALL) rt ON rt.repo_id = r.repo_id AND rt.unit = r.unit
          LEFT JOIN topic_similarity ts ON ts.repo_id = l.repo_id AND ts.unit = l.unit""",
    "period": "SELECT *, (CAST(left(authored_date, 4) AS BIGINT) - 1990) // 2 AS milestone FROM riding",
    "described": """
        SELECT *, NOT is_merge AND (NOT rides OR NOT bool_or(NOT is_merge AND NOT rides) OVER (PARTITION BY repo_id, milestone)) AS is_described FROM period""",
    "period_changes": "SELECT p.repo_id, p.milestone, p.is_described, c.path, c.additions, c.deletions FROM described p JOIN changes c USING (repo_id, sha) WHERE NOT p.is_merge",
    "theme_notes": f"""
        SELECT repo_id, milestone, seq, {O.topic_key('scope')} AS theme, scope AS label, 1.0 AS w FROM described WHERE is_described AND scope IS NOT NULL
        UNION ALL
        SELECT d.repo_id, d.milestone, d.seq, t.topic, t.topic, t.weight * 0.75 FROM described d JOIN topics t USING (repo_id, sha)
        WHERE is_described AND (d.scope IS NULL OR t.topic <> {O.topic_key('d.scope')})""",
    "theme_rows": """
        SELECT *, max(weight) OVER (PARTITION BY repo_id, milestone) AS leader FROM (
          SELECT repo_id, milestone, theme, round(sum(w), 9) AS weight, first(label ORDER BY spelling DESC, first_seq) AS label FROM (
            SELECT repo_id, milestone, theme, label, sum(w) AS w, round(sum(w + CASE WHEN label = theme THEN 0.5 ELSE 0 END), 9) AS spelling, min(seq) AS first_seq
            FROM theme_notes GROUP BY ALL) GROUP BY ALL) WHERE theme <> 'project root'""",
    "eligible": """
        SELECT p.*, a.any_tag FROM period p LEFT JOIN (SELECT repo_id, sha, arg_max(name, pos) AS any_tag FROM tags GROUP BY ALL) a USING (repo_id, sha)
        WHERE NOT is_merge AND files_changed > 0 AND churn > 0""",
    "largest": """
        SELECT repo_id, milestone, arg_max(sha, CAST(churn AS HUGEINT) * 10000000 - seq) AS sha FROM eligible GROUP BY ALL HAVING count(*) >= 3""",
    "choice_candidates": f"""
        SELECT repo_id, seq, sha, short_sha, subject, kind, only_docs, body,
          NOT only_docs AND NOT regexp_matches(subject, {O.text(rules.TYPO_WORD)})
            AND {O.any_match(f"regexp_replace({O.subject_text()}, {O.text(rules.AREA_PREFIX_STRIP)}, '')", rules.EXPLICIT_CHOICE_SUBJECTS)} AS explicit,
          CASE WHEN starts_with(body, 'Cache') THEN body WHEN starts_with(body, 'Keep') THEN replace(body, chr(10), ' ') END AS detail
        FROM people WHERE NOT is_merge""",
    "commit_decision_rows": """
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY explicit DESC, seq) AS rank FROM choice_candidates
        WHERE explicit OR (detail IS NOT NULL AND kind NOT IN ('fix', 'docs', 'test', 'style', 'revert'))
        QUALIFY rank <= 10""",
    "scored": """
        SELECT e.*, l.sha IS NOT NULL AS is_largest, d.sha IS NOT NULL AS is_decision, round(
          least(5.0, log2(1.0 + churn) * 0.5) + CASE WHEN len(trim(e.body)) >= 40 THEN 2.0 ELSE 0 END + CASE WHEN touches_tests AND touches_source THEN 1.5 ELSE 0 END
          + CASE WHEN e.kind IN ('feat', 'fix', 'perf', 'refactor') THEN 1 ELSE 0 END - CASE WHEN e.kind IN ('docs', 'style', 'chore', 'build', 'ci') THEN 1 ELSE 0 END
          + CASE WHEN d.sha IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN any_tag IS NOT NULL THEN 1 ELSE 0 END
          - CASE WHEN files_changed > 150 OR vendored > files_changed / 2 THEN 3 ELSE 0 END, 9) AS score
        FROM eligible e LEFT JOIN largest l ON l.repo_id = e.repo_id AND l.sha = e.sha LEFT JOIN commit_decision_rows d ON d.repo_id = e.repo_id AND d.sha = e.sha""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, seq) AS rank, count(*) OVER (PARTITION BY repo_id) AS eligible_commits FROM scored""",
    "medians": "SELECT *, max(CASE WHEN rank = eligible_commits // 2 + 1 THEN score END) OVER (PARTITION BY repo_id) AS median FROM ranked",
    "best": "SELECT *, rank = min(rank) OVER (PARTITION BY repo_id, milestone) AND score >= median AS is_best FROM medians",
    "chosen": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN is_best THEN 0 ELSE 1 END, rank) AS place FROM best)
        WHERE place <= least(6, greatest(1, CAST(ceil(eligible_commits / 3) AS BIGINT)))""",
}


def _units(c):
    s = I.summaries(c)
    # the queries below read these columns only
    riding = lambda: K.with_riding(K.people(s), c.tags()).select(*K.KEY, "seq", "authored_ms", "kind", "rides", "weight", "churn")
    return s, c.table("units", lambda: M.unit_commits(riding()))


def _features(c):
    changes = c.changes()
    s, units = _units(c)
    return c.table("unit_features", lambda: M.unit_features(units, K.commit_topics(s, changes)))


@query("ride_along_units", "SELECT repo_id, sha, CAST(unit AS BIGINT) AS unit FROM unit_commits", X)
def ride_along_units(c):
    return _units(c)[1].select("repo_id", "sha", "unit")


@query("unit_features", """
    SELECT repo_id, unit, n, start, end_ms AS "end", weight, churn, round(mass, 9) AS mass,
      coalesce((SELECT string_agg(topic || '=' || round(weight, 6), ' ' ORDER BY topic) FROM topics t JOIN described_openers o USING (repo_id, sha)
        WHERE o.repo_id = m.repo_id AND o.unit = m.unit), '') AS topics,
      coalesce((SELECT kind FROM described_openers o WHERE o.repo_id = m.repo_id AND o.unit = m.unit), '') AS kinds FROM masses m""".replace("round(weight, 6)", "CAST(round(t.weight, 6) AS VARCHAR)"), X)
def unit_features(c):
    words = F.transform(F.map_entries("topics"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string")))
    return _features(c).select("repo_id", "unit", "n", "start", "end", "weight", "churn", F.round("mass", 9).alias("mass"),
                               F.array_join(words, " ").alias("topics"), F.array_join(F.map_keys("kinds"), " ").alias("kinds"))


@query("adjacent_merge_cost", "SELECT repo_id, unit, next_unit, round(cost, 8) AS cost FROM costs", X)
def adjacent_merge_cost(c):
    return M.adjacent_merge_cost(_features(c)).withColumn("cost", F.round("cost", 8))


@query("milestone_target", "SELECT repo_id, count(*) AS units, max(target) AS target FROM masses GROUP BY repo_id", X)
def milestone_target(c):
    return clustering.repository_limits(_features(c)).select("repo_id", "units", "target")


@query("weighted_jaccard", """
    SELECT a.conv_id, round(sum(least(a.s, b.s)) / sum(greatest(a.s, b.s)), 9) AS similarity FROM (
      SELECT conv_id, part, sum(s) AS s FROM (SELECT conv_id, part, n / sum(n) OVER (PARTITION BY conv_id) AS s FROM sides WHERE side = 'a' UNION ALL
        SELECT conv_id, part, 0.0 FROM sides WHERE side = 'b') GROUP BY ALL) a
    JOIN (SELECT conv_id, part, sum(s) AS s FROM (SELECT conv_id, part, n / sum(n) OVER (PARTITION BY conv_id) AS s FROM sides WHERE side = 'b' UNION ALL
        SELECT conv_id, part, 0.0 FROM sides WHERE side = 'a') GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.part = b.part GROUP BY a.conv_id""", {
    "sides": """SELECT conv_id, CASE role WHEN 'user' THEN 'a' ELSE 'b' END AS side, len(text) % 7 AS part, count(*) AS n FROM conversations
        WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role <> 'user')) GROUP BY ALL"""})
def weighted_jaccard(c):
    parts = c.raw("conversations").groupBy("conv_id", F.when(F.col("role") == "user", "a").otherwise("b").alias("side"), (F.length("text") % 7).alias("part")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    entry = F.struct("part", "n")
    maps = parts.groupBy("conv_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, entry))).alias(s) for s in "ab"])
    both = maps.filter((F.size("a") > 0) & (F.size("b") > 0))
    return both.select("conv_id", F.round(C.weighted_jaccard("a", "b"), 9).alias("similarity"))


@query("time_gap_cost", """
    SELECT repo_id, sha, round(least(1.0, ln(1 + gap) / ln(337.0)), 9) AS cost FROM (
      SELECT repo_id, sha, seq, greatest(0, authored_ms - lag(authored_ms) OVER (PARTITION BY repo_id ORDER BY seq)) / 3600000.0 AS gap FROM kcommits QUALIFY lag(seq) OVER (PARTITION BY repo_id ORDER BY seq) IS NOT NULL)""")
def time_gap_cost(c):
    commits = c.commits().select("repo_id", "sha", "seq", "authored_ms")
    before = commits.select("repo_id", (F.col("seq") + 1).alias("seq"), F.col("authored_ms").alias("previous_ms"))
    gap = F.greatest(F.lit(0), F.col("authored_ms") - F.col("previous_ms")) / 3_600_000
    return commits.join(before, ["repo_id", "seq"]).select("repo_id", "sha", F.round(C.time_gap_cost(gap), 9).alias("cost"))


# ---------------------------------------------------------------------- clustering
@query("milestones")
def milestones(c):
    m = I.study(c).milestones
    return m.select("repo_id", "id", "title", "summary", "start_at", "end_at", "commits", I.joined("themes").alias("themes"), F.to_json("kinds").alias("kinds"), "tag_count",
                    "first_tag", "last_tag", "additions", "deletions", "files_changed")


@query("milestone_members", "SELECT repo_id, sha FROM people")
def milestone_members(c):
    """Exact cover: every commit by a person is in exactly one milestone (the milestone is checked by tests)."""
    return I.study(c).members.select("repo_id", "sha")


@query("record_ids")
def record_ids(c):
    s = I.study(c)
    milestone_ids = s.milestones.select("repo_id", "id", F.col("title"))
    return milestone_ids.unionByName(s.decisions.select("repo_id", "id", "title"))


# ---------------------------------------------------------------------- given groups
@query("milestone_stats", f"""
    SELECT p.repo_id, p.milestone, count(*) AS commits, CAST(coalesce(sum(additions) FILTER (NOT is_merge), 0) AS BIGINT) AS additions,
      CAST(coalesce(sum(deletions) FILTER (NOT is_merge), 0) AS BIGINT) AS deletions,
      arg_min(authored_raw, CAST(authored_ms AS HUGEINT) * 10000000 + seq) AS start_at, arg_max(authored_raw, CAST(authored_ms AS HUGEINT) * 10000000 + seq) AS end_at,
      arg_min(sha, seq) AS first_sha, arg_max(sha, seq) AS last_sha,
      coalesce((SELECT count(DISTINCT path) FROM period_changes f WHERE f.repo_id = p.repo_id AND f.milestone = p.milestone), 0) AS files_changed
    FROM period p GROUP BY ALL""", X)
def milestone_stats(c):
    changes = c.changes()
    members = I.period_members(c)
    stats = M.milestone_stats(members, M.member_changes(M.with_described(members), changes))
    return stats.select("repo_id", "milestone", "commits", "additions", "deletions", "start_at", "end_at", "first_sha", "last_sha", "files_changed")


@query("milestone_top_areas", f"""
    SELECT repo_id, milestone, area, churn, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, milestone ORDER BY churn DESC, lower(area)) AS rank FROM (
        SELECT repo_id, milestone, {O.area()} AS area, CAST(sum({_CHURN}) AS BIGINT) AS churn FROM period_changes WHERE is_described GROUP BY ALL)) WHERE rank <= 3""", X)
def milestone_top_areas(c):
    members = I.period_members(c)
    return M.top_areas(M.member_changes(M.with_described(members), c.changes())).select("repo_id", "milestone", "area", "churn", "rank")


@query("milestone_themes", "SELECT repo_id, milestone, theme, label, round(weight, 6) AS weight FROM theme_rows WHERE weight >= leader * 0.35", X)
def milestone_themes(c):
    changes = c.changes()
    members = I.period_members(c)
    return M.themes(M.with_described(members), K.commit_topics(members, changes)).select("repo_id", "milestone", "theme", "label", F.round("weight", 6).alias("weight"))


@query("work_label", f"""
    SELECT repo_id, milestone, CASE
        WHEN len(r) = 0 OR r[1].kind = 'other' THEN 'Development' WHEN r[1].n / size >= 0.6 THEN r[1].label
        WHEN len(r) > 1 AND r[2].kind <> 'other' AND (r[1].n + r[2].n) / size >= 0.75 THEN r[1].label || ' and ' || lower(r[2].label) ELSE 'Development' END AS label
    FROM (SELECT repo_id, milestone, greatest(1, sum(n)) AS size, list({{'kind': kind, 'n': n, 'label': {_LABEL.format(k='kind')}}} ORDER BY n DESC, churn DESC, {_PRIORITY}) AS r
      FROM (SELECT *, sum(n) OVER g AS total, coalesce(sum(CASE WHEN kind <> 'other' THEN n END) OVER g, 0) AS known FROM (
          SELECT repo_id, milestone, kind, count(*) AS n, sum(churn) AS churn FROM described WHERE is_described GROUP BY ALL) WINDOW g AS (PARTITION BY repo_id, milestone))
      WHERE kind <> 'other' OR known < total / 2 GROUP BY repo_id, milestone)""", X)
def work_label(c):
    return M.work_label(M.with_described(I.period_members(c))).select("repo_id", "milestone", "label")


@query("milestone_commit_listing", """
    SELECT repo_id, milestone, rank, short_sha, subject, greatest(0, n - 12) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, milestone ORDER BY seq) AS rank, count(*) OVER (PARTITION BY repo_id, milestone) AS n FROM period) WHERE rank <= 12""", X)
def milestone_commit_listing(c):
    return M.commit_listing(I.period_members(c))


# ---------------------------------------------------------------------- highlighted commits
def _scored(c):
    members = I.period_members(c)
    candidates = highlights.eligible(highlights.commit_context(members, c.tags()))
    return c.table("period_scores", lambda: highlights.commit_score(candidates, decisions.decision_shas(decisions.commit_decisions(members))))


@query("commit_context", """
    SELECT p.repo_id, p.sha, p.milestone, (SELECT arg_max(name, pos) FROM tags t WHERE t.repo_id = p.repo_id AND t.sha = p.sha) AS tag, p.body FROM period p""", X)
def commit_context(c):
    return highlights.commit_context(I.period_members(c), c.tags()).select("repo_id", "sha", "milestone", F.col("any_tag").alias("tag"), "body")


@query("largest_in_milestone", "SELECT repo_id, milestone, sha FROM largest", X)
def largest_in_milestone(c):
    return highlights.largest_in_milestone(highlights.eligible(highlights.commit_context(I.period_members(c), c.tags())))


@query("commit_score", """
    SELECT repo_id, sha, round(score, 6) AS score, array_to_string(list_filter([
      CASE WHEN len(trim(body)) >= 40 THEN 'Message body explains the change (' || CASE WHEN contains(body, chr(10)) THEN '2 lines)' ELSE '1 line)' END END,
      CASE WHEN touches_tests AND touches_source THEN 'Changes tests alongside implementation' END,
      CASE WHEN is_decision THEN 'Commit message records a technical decision' END, CASE WHEN any_tag IS NOT NULL THEN 'Tagged `' || any_tag || '`' END,
      CASE WHEN is_largest THEN 'Largest change in milestone M' || milestone || ' (+' || format('{:,}', additions) || ' −' || format('{:,}', deletions) || ')' END],
      lambda r: r IS NOT NULL), '; ') AS reasons FROM scored""", X)
def commit_score(c):
    return _scored(c).select("repo_id", "sha", F.round("score", 6).alias("score"), I.joined("reasons").alias("reasons"))


@query("commit_score_rank", "SELECT repo_id, sha, rank, round(median, 6) AS median FROM medians", X)
def commit_score_rank(c):
    return highlights.with_median(highlights.commit_score_rank(_scored(c))).select("repo_id", "sha", "rank", F.round("median", 6).alias("median"))


@query("milestone_best_commit", "SELECT repo_id, milestone, sha FROM best WHERE is_best", X)
def milestone_best_commit(c):
    return highlights.milestone_best_commit(highlights.with_median(_scored(c))).select("repo_id", "milestone", "sha")


@query("top_selected_commits", "SELECT repo_id, sha, 'M' || milestone AS milestone FROM chosen", X)
def top_selected_commits(c):
    return highlights.selected_commits(highlights.with_median(_scored(c)), c.changes()).select("repo_id", "sha", "milestone")


@query("selected_commits")
def selected_commits(c):
    return I.study(c).selected_commits.select(
        "repo_id", "sha", "authored_raw", "subject", "files_changed", "additions", "deletions", "milestone", I.joined("reasons").alias("reasons"))


# ---------------------------------------------------------------------- commit decisions
@query("commit_decisions", f"""
    SELECT repo_id, upper(left({O.subject_text()}, 1)) || substr({O.subject_text()}, 2) AS title, detail, 'Commit message `' || short_sha || '`' AS basis FROM commit_decision_rows""", X)
def commit_decisions(c):
    return decisions.commit_decisions(I.people(c)).select("repo_id", "title", "detail", "basis")


@query("top_commit_decisions", "SELECT repo_id, sha, explicit, rank FROM commit_decision_rows", X)
def top_commit_decisions(c):
    return decisions.top_commit_decisions(decisions.commit_decision_candidates(I.people(c))).select("repo_id", "sha", "explicit", "rank")


@query("decision_commits", "SELECT repo_id, sha, upper(left(t, 1)) || substr(t, 2) AS title FROM (SELECT repo_id, sha, " + O.subject_text() + " AS t FROM commit_decision_rows)", X)
def decision_commits(c):
    return decisions.decision_shas(decisions.commit_decisions(I.people(c))).select("repo_id", "sha", "title")
