"""Facts from package manifests.

JSON, Go, CMake and .NET manifests are read with built-in expressions.  Only the TOML and
INI dialects go through a small vectorized reader, on manifest rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T

FIELDS = ["name", "description", "version", "license", "homepage"]
FACTS = (
    "ecosystem string, name string, description string, version string, license string, homepage string, "
    "scripts map<string,string>, script_order array<string>, dependencies array<string>, dev_dependencies array<string>, "
    "binaries array<string>, details map<string,string>")
COLUMNS = ["repo_id", "path"] + [c.split()[0] for c in FACTS.replace("map<string,string>", "map").split(", ")]


def strip_json_comments(text) -> Column:
    """Comments and trailing commas removed; strings stay as they are."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, r'("(?:[^"\\]++|\\[\s\S])*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(t, r",(\s*[}\]])", "$1")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _json_facts(documents: DataFrame) -> DataFrame:
    name = P.base_name("path")
    is_npm = name == "package.json"
    json = F.when(is_npm, F.col("text")).otherwise(strip_json_comments("text"))
    parsed = documents.filter(name.isin("package.json", "deno.json", "deno.jsonc")).select(
        "repo_id", "path", is_npm.alias("npm"), json.alias("json"), F.try_parse_json(json).alias("v")
    ).filter(F.schema_of_variant("v").startswith("OBJECT"))

    def string_at(path: str) -> Column:
        node = F.try_variant_get("v", path, "variant")
        value = T.trim(F.try_variant_get("v", path, "string"))
        return F.when((F.schema_of_variant(node) == "STRING") & (value != ""), value)

    def string_keys(key: str) -> Column:
        """Keys of an object whose values are strings, in document order."""
        body = F.get_json_object("json", f"$.{key}")
        values = F.from_json(body, "map<string,variant>")
        keys = F.json_object_keys(body)
        kept = F.filter(keys, lambda k: F.coalesce(F.schema_of_variant(F.try_element_at(values, k)) == "STRING", F.lit(False)))
        return F.coalesce(kept, _strings())

    def string_map(key: str) -> Column:
        values = F.from_json(F.get_json_object("json", f"$.{key}"), "map<string,string>")
        keys = string_keys(key)
        return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(values, k))), _no_map())

    npm = F.col("npm")
    empty = _strings()
    package_name = string_at("$.name")
    bin_text = string_at("$.bin")
    homepage = F.coalesce(string_at("$.homepage"), string_at("$.repository"), string_at("$.repository.url"))
    details = F.map_filter(
        F.map_concat(
            F.create_map(
                F.lit("packageManager"), string_at("$.packageManager"),
                F.lit("workspaces"), F.when(F.try_variant_get("v", "$.workspaces", "variant").isNotNull(), "yes"),
                F.lit("module"), F.when(string_at("$.type") == "module", "ESM")),
            F.transform_keys(string_map("engines"), lambda k, _: F.concat(F.lit("engines."), k))),
        lambda _, value: value.isNotNull())
    scripts = F.when(npm, string_map("scripts")).otherwise(string_map("tasks"))
    return parsed.select(
        "repo_id", "path", F.when(npm, "npm").otherwise("deno").alias("ecosystem"), package_name.alias("name"),
        *[string_at(f"$.{f}").alias(f) for f in FIELDS[1:4]], F.when(npm, homepage).alias("homepage"),
        scripts.alias("scripts"), F.map_keys(scripts).alias("script_order"),
        F.when(npm, F.concat(string_keys("dependencies"), string_keys("peerDependencies"))).otherwise(string_keys("imports")).alias("dependencies"),
        F.when(npm, string_keys("devDependencies")).otherwise(empty).alias("dev_dependencies"),
        F.when(~npm, empty).when(bin_text.isNotNull() & package_name.isNotNull(), F.array(F.regexp_replace(package_name, r"^@[^/]+/", "")))
        .otherwise(string_keys("bin")).alias("binaries"),
        F.when(npm, details).otherwise(_no_map()).alias("details"))


def _details(pairs: list[tuple[str, Column]]) -> Column:
    return F.map_filter(F.create_map(*[c for k, v in pairs for c in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _found(pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract("text", pattern, group)
    return F.when(value != "", value)


def _text_facts(documents: DataFrame) -> DataFrame:
    """Go modules, CMake projects and .NET projects."""
    name = P.base_name("path")
    go, cmake = name == "go.mod", name == "CMakeLists.txt"
    dotnet = name.rlike(rules.DOTNET_PROJECT)
    lines = F.transform(F.split(T.unix_lines("text"), "\n"), lambda s: T.trim(F.regexp_replace(s, r"//.*\z", "")))
    # Inside "require ( ... )" every line names a module first; elsewhere "require name version".
    uncommented = F.array_join(lines, "\n")
    blocks = F.regexp_extract_all(uncommented, F.lit(r"(?m)^require\s*\(\n([^)]*)"), F.lit(1))
    block_names = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^(\S+)"), F.lit(1))))
    single_names = F.regexp_extract_all(uncommented, F.lit(r"(?m)^require\s+([^\s(]\S*)\s"), F.lit(1))
    found_packages = F.regexp_extract_all("text", F.lit(r"(?i)find_package\s*\(\s*([A-Za-z0-9_]+)"), F.lit(1))
    references = F.regexp_extract_all("text", F.lit(r'<PackageReference\s+Include="([^"]+)"'), F.lit(1))
    module = _found(r"(?m)^module\s+(\S+)")
    return documents.filter(go | cmake | dotnet).select(
        "repo_id", "path", F.when(go, "go").when(cmake, "cmake").otherwise("dotnet").alias("ecosystem"),
        F.when(go, module).when(cmake, _found(r"(?im)^\s*project\s*\(\s*([A-Za-z0-9_.+-]+)"))
        .otherwise(F.regexp_replace(name, rules.DOTNET_PROJECT, "")).alias("name"),
        F.when(dotnet, T.trim(_found(r"<Description>([^<]+)</Description>"))).alias("description"),
        *[F.lit(None).cast("string").alias(f) for f in FIELDS[2:]],
        _no_map().alias("scripts"), _strings().alias("script_order"),
        F.when(go, F.array_distinct(F.concat(block_names, single_names))).when(cmake, F.array_distinct(found_packages)).otherwise(references).alias("dependencies"),
        _strings().alias("dev_dependencies"), _strings().alias("binaries"),
        F.when(go, _details([("module", module), ("go", _found(r"(?m)^go\s+(\S+)"))]))
        .when(cmake, _details([
            ("ctest", F.when(F.col("text").rlike(r"(?i)\benable_testing\s*\(|\badd_test\s*\("), "yes")),
            ("cxxStandard", _found(r"CMAKE_CXX_STANDARD\s+(\d+)"))]))
        .otherwise(_details([("targetFramework", T.trim(_found(r"<TargetFrameworks?>([^<]+)</TargetFrameworks?>")))])).alias("details"))


# ---------------------------------------------------------------------- TOML and INI rows
_QUOTED = r'"(?:[^"\\]|\\.)*"|\'[^\']*\''


def toml_tables(text: str) -> dict[str, dict[str, object]]:
    """Tables of a TOML manifest: strings, string lists, booleans; other values as presence."""
    tables: dict[str, dict[str, object]] = {"": {}}
    table = tables[""]
    rows = iter(re.split(r"\r?\n", text))

    def bare(row: str) -> str:
        head = re.match(rf"(?:[^\"'#]|{_QUOTED})*", row).group()
        return (head if row[len(head):len(head) + 1] == "#" else row).strip()

    for row in rows:
        line = bare(row)
        if header := re.fullmatch(r"\[\[?\s*([^\]]+?)\s*\]\]?", line):
            table = tables.setdefault(re.sub(r"\s*\.\s*", ".", header[1]).replace('"', ""), {})
            continue
        if not (pair := re.fullmatch(r"(\"[^\"]+\"|'[^']+'|[A-Za-z0-9_.-]+)\s*=\s*(.*)", line)):
            continue
        key, value = pair[1].strip("\"'"), pair[2]
        if value.startswith("["):
            while (plain := re.sub(_QUOTED, "", value)).count("[") > plain.count("]") and (more := next(rows, None)) is not None:
                value += " " + bare(more)
            table[key] = [m[0] or m[1] for m in re.findall(r'"((?:[^"\\]|\\.)*)"|\'([^\']*)\'', value)]
        elif value[:3] in ('"""', "'''"):
            quote, body = value[:3], value[3:]
            while quote not in body and (more := next(rows, None)) is not None:
                body += "\n" + more
            table[key] = body.split(quote)[0].strip()
        elif string := re.match(r'"((?:[^"\\]|\\.)*)"|\'([^\']*)\'', value):
            table[key] = re.sub(r"\\(.)", r"\1", string[1]) if string[1] is not None else string[2]
        elif value.startswith("{"):
            table[key] = {}
        elif value in ("true", "false") or re.fullmatch(r"[+-]?\d[\d_]*(\.\d+)?", value):
            table[key] = value == "true"
    return tables


def ini_sections(text: str) -> dict[str, dict[str, str]]:
    sections: dict[str, dict[str, str]] = {}
    section = key = None
    for line in re.split(r"\r?\n", text):
        if not line.strip() or re.match(r"\s*[#;]", line):
            continue
        if header := re.match(r"\[([^\]]+)\]\s*$", line):
            section, key = sections.setdefault(header[1].strip(), {}), None
            section.clear()
        elif line[0].isspace() and section is not None and key:
            section[key] += "\n" + line.strip()
        elif section is not None and (pair := re.match(r"([^=:]+?)\s*[=:]\s*(.*)$", line)):
            key = pair[1].strip().lower().replace("-", "_")
            section[key] = pair[2]
    return sections


def _requirement(value: str) -> str:
    match = re.match(r"\s*([A-Za-z0-9_.-]+)", value)
    return (match[1] if match else value).lower()


def _table_keys(tables, name: str) -> list[str]:
    dotted = [t[len(name) + 1:].split(".")[0] for t in tables if t.startswith(name + ".")]
    return [k for k in dict.fromkeys([*tables.get(name, {}), *dotted]) if k]


def _common(table: dict) -> dict:
    facts = {f: table[f].strip() for f in FIELDS if isinstance(table.get(f), str) and table[f].strip()}
    if "homepage" not in facts and isinstance(table.get("repository"), str):
        facts["homepage"] = table["repository"]
    return facts


def cargo_facts(text: str) -> dict:
    tables = toml_tables(text)
    package = tables.get("package", {})
    details = {"edition": package["edition"]} if isinstance(package.get("edition"), str) else {}
    if "workspace" in tables:
        details["workspace"] = "yes"
    binary = tables.get("bin", {}).get("name")
    return {**_common(package), "ecosystem": "cargo", "details": details,
            "dependencies": _table_keys(tables, "dependencies"), "dev_dependencies": _table_keys(tables, "dev-dependencies"),
            "binaries": [binary] if isinstance(binary, str) else []}


def pyproject_facts(text: str) -> dict:
    tables = toml_tables(text)
    lists = lambda name: [v for v in tables.get(name, {}).values() if isinstance(v, list)]
    declared = tables.get("project", {}).get("dependencies")
    dev = _table_keys(tables, "tool.poetry.dev-dependencies") + _table_keys(tables, "tool.poetry.group.dev.dependencies")
    dev += [_requirement(r) for name in ("project.optional-dependencies", "dependency-groups") for group in lists(name) for r in group]
    details = {f"tool.{t}": "configured" for t in rules.PYPROJECT_TOOLS if any(s == f"tool.{t}" or s.startswith(f"tool.{t}.") for s in tables)}
    backend = tables.get("build-system", {}).get("build-backend")
    if isinstance(backend, str):
        details["buildBackend"] = backend
    return {**_common(tables.get("project", tables.get("tool.poetry", {}))), "ecosystem": "python", "details": details,
            "dependencies": [_requirement(r) for r in declared or [] if isinstance(declared, list)]
            + [k for k in _table_keys(tables, "tool.poetry.dependencies") if k != "python"],
            "dev_dependencies": dev, "binaries": list(tables.get("project.scripts", {}))}


def setup_cfg_facts(text: str) -> dict | None:
    sections = ini_sections(text)
    if "metadata" not in sections:
        return None
    facts: dict = {}
    for field, keys in {"name": ["name"], "description": ["description", "summary"], "version": ["version"],
                        "license": ["license"], "homepage": ["url", "home_page"]}.items():
        values = [sections["metadata"].get(k, "").strip() for k in keys]
        literal = [v for v in values if v and not re.match(r"(attr|file):", v)]
        if literal:
            facts[field] = literal[0]
    listed = lambda section, key: [v for v in (r.split(";")[0].strip() for r in sections.get(section, {}).get(key, "").split("\n")) if v and v[0] != "#"]
    return {**facts, "ecosystem": "python", "dependencies": [_requirement(r) for r in listed("options", "install_requires")], "dev_dependencies": [],
            "binaries": [n for n in (e.split("=")[0].strip() for e in listed("options.entry_points", "console_scripts")) if n],
            "details": {f"tool.{t.replace('tool:', '')}": "configured" for t in rules.SETUP_CFG_TOOLS if t in sections}}


_READERS = {"Cargo.toml": cargo_facts, "pyproject.toml": pyproject_facts, "setup.cfg": setup_cfg_facts}


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo_id, path, text in zip(batch["repo_id"], batch["path"], batch["text"]):
            facts = _READERS[path.rsplit("/", 1)[-1]](text)
            if facts is not None:
                row = {"repo_id": repo_id, "path": path, "scripts": {}, "script_order": [], **facts}
                rows.append([row.get(c) for c in COLUMNS])
        yield pd.DataFrame(rows, columns=COLUMNS)


def manifest_facts(documents: DataFrame) -> DataFrame:
    """One row per readable manifest, in no order; malformed ones give no row."""
    columns = documents.select("repo_id", "path", "text").filter(P.is_manifest("path"))
    scanned = columns.filter(P.base_name("path").isin(*_READERS)).mapInPandas(_read_batches, f"repo_id long, path string, {FACTS}")
    return _json_facts(columns).select(*COLUMNS).unionByName(_text_facts(columns).select(*COLUMNS)).unionByName(scanned)


def ordered_manifests(manifests: DataFrame) -> DataFrame:
    """Adds the reading order (depth, then path) and marks the root manifest.

    A repository has at most 200 documents, so the window is bounded.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("repo_id").orderBy(P.depth("path"), T.locale_key("path"), "path")
    numbered = manifests.withColumn("manifest_pos", F.row_number().over(order).cast("long"))
    return numbered.withColumn("is_root", (F.col("manifest_pos") == 1) & ~F.col("path").contains("/"))
