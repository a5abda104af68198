"""Shell command text: segments, essentials, script expansion and purposes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T

_VARIABLE = r"(\$\{\{\s*env\.[A-Za-z_][A-Za-z0-9_]*\s*\}\}|\$\{?[A-Z][A-Z0-9_]*\}?)"


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def no_scripts() -> Column:
    return F.create_map().cast("map<string,string>")


def segments(command) -> Column:
    """The single commands of a shell line or script; here-document bodies are data."""
    code = F.regexp_replace(_column(command), rules.HEREDOC, "")
    return F.filter(F.transform(F.split(code, r"&&|\|\||;|\||\n", -1), T.trim), lambda s: s != "")


def script_names(command) -> Column:
    return F.filter(F.transform(segments(command), lambda s: F.regexp_extract(s, rules.SCRIPT_RUN, 1)), lambda n: n != "")


def script_name(command) -> Column:
    name = F.regexp_extract(T.trim(command), rules.SCRIPT_RUN, 1)
    return F.when(name != "", name)


def reached_scripts(command, scripts) -> Column:
    """Names of the scripts a command runs, directly or through others, depth first, at most ten."""
    scripts = _column(scripts)
    start = F.struct(F.array().cast("array<string>").alias("seen"), script_names(command).alias("stack"))

    def visit(state: Column, _: Column) -> Column:
        open_names = F.filter(state["stack"], lambda n: F.map_contains_key(scripts, n) & ~F.array_contains(state["seen"], n))
        name = F.try_element_at(open_names, F.lit(1))
        rest = F.slice(open_names, F.lit(2), F.greatest(F.size(open_names) - 1, F.lit(0)))
        advanced = F.struct(
            F.array_append(state["seen"], name).alias("seen"),
            F.concat(script_names(F.coalesce(F.try_element_at(scripts, name), F.lit(""))), rest).alias("stack"))
        return F.when(F.size(open_names) == 0, state).otherwise(advanced)

    steps = F.sequence(F.lit(1), F.lit(rules.MAX_EXPANDED_SCRIPTS))
    return F.aggregate(steps, start, visit, lambda state: state["seen"])


def substitute_variables(command) -> Column:
    """Variables read as the lower-cased command they name."""
    c = _column(command)
    names = F.transform(F.regexp_extract_all(c, F.lit(_VARIABLE), F.lit(1)),
                        lambda m: F.lower(F.regexp_extract(m, r"([A-Za-z_][A-Za-z0-9_]*)\s*\}*\z", 1)))
    parts = F.split(c, _VARIABLE, -1)
    return F.array_join(F.flatten(F.zip_with(parts, names, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")


def _make_targets(subject) -> Column:
    arguments = F.transform(segments(subject), lambda s: F.regexp_extract(s, rules.MAKE_RUN, 1))
    tokens = F.flatten(F.transform(arguments, lambda a: F.split(a, r"\s+")))
    return F.transform(F.filter(tokens, lambda t: (t != "") & ~t.startswith("-") & ~t.contains("=")), F.lower)


def _matches(pattern: str):
    return lambda token: token.rlike(pattern)


def purposes_of_text(subject) -> Column:
    """Purposes recognized in a command text, in their fixed order."""
    s = _column(subject)
    by_target = dict(rules.TARGET_PURPOSES)
    targets = F.when(s.rlike(r"make|just"), _make_targets(s)).otherwise(F.array().cast("array<string>"))
    found = []
    for purpose, pattern in rules.PURPOSES:
        hit = s.rlike(pattern)
        if purpose in by_target:
            hit = hit | F.exists(targets, _matches(by_target[purpose]))
        found.append(F.when(hit, F.lit(purpose)))
    return F.array_compact(F.array(*found))


def expanded_text(command, scripts) -> Column:
    scripts = _column(scripts)
    bodies = F.transform(reached_scripts(command, scripts), lambda n: F.element_at(scripts, n))
    return F.array_join(F.transform(F.concat(F.array(_column(command)), bodies), substitute_variables), "\n")


def is_plumbing(command) -> Column:
    return _column(command).rlike(rules.SHELL_PLUMBING)


def command_key(segment) -> Column:
    """What identifies a command: no paths, quotes, redirections, assignments or wrappers."""
    bare = T.trim(F.regexp_replace(_column(segment), r"\s*\d?>>?&?\s*\S+", ""))
    plain = F.regexp_replace(bare, r"^(?:[A-Z_][A-Z0-9_]*=\S*(?:\s+|\z))+", "")
    plain = F.regexp_replace(plain, r"^timeout(?:\s+\d\S*)?(?:\s+|\z)", "")
    tokens = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
    first = F.try_element_at(tokens, F.lit(1))
    kept = F.filter(tokens, lambda t, i: (i == 0) | (~t.rlike(r"[/\\'\"$`]") & ~t.rlike(r"^\.|\.\w{1,5}\z")))
    return F.when(first.isNotNull() & ~first.isin("cd", "echo"), T.truncate(F.array_join(F.slice(kept, 1, 4), " "), 60))


def test_summary(text) -> Column:
    """The summary line of a known test runner, else null."""
    t, p = _column(text), rules.TEST_SUMMARY_PATTERNS
    part = lambda name, group: F.regexp_extract(t, p[name], group)
    return F.coalesce(
        F.when(t.rlike(p["pass_fail"]), F.concat(part("pass_fail", 1), F.lit(" pass, "), part("pass_fail", 2), F.lit(" fail"))),
        F.when(t.rlike(p["pytest"]), part("pytest", 1)),
        F.when(t.rlike(p["cargo"]), F.concat(part("cargo", 2), F.lit(" passed, "), part("cargo", 3), F.lit(" failed"))),
        F.when(t.rlike(p["jest"]), T.trim(part("jest", 1))),
        F.when(t.rlike(p["vitest"]), F.regexp_replace(part("vitest", 1), r"\s+", " ")),
        F.when(t.rlike(p["go"]), T.trim(F.regexp_extract(t, p["go"], 0))))
