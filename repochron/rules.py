"""Fixed values of the data model: word lists, name patterns and rule tables.

Everything here is data, not logic.  The values have to be exactly these for
results to be right, so they are listed plainly and in natural order.  Patterns
are written in the dialect shared by Java and RE2 (``\\z`` for end of text,
inline ``(?i)`` flags) unless a comment says otherwise.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: white space
# The characters ECMAScript counts as white space, as the inside of a character class.
JS_SPACE = "\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# ---------------------------------------------------------------- fixed values: path patterns
TEST_FILE_PATTERNS = [
    r"(^|/)(__tests__|__test__)/",
    r"\.(test|spec)\.[cm]?[jt]sx?\z",
    r"\.(test|spec)\.(py|rb|go|rs|php|kt|swift|dart|ex|exs)\z",
    r"(^|/)test_[^/]+\.py\z",
    r"_test\.(py|go|exs|dart)\z",
    r"_spec\.rb\z",
    r"(Test|Tests|Spec)\.(java|kt|cs|swift|scala|php)\z",
    r"(?i)(^|/)(tests?|spec|specs|testing)/.+\.[a-z0-9]+\z",
]
TEST_SUPPORT = r"(?i)(^|/)(fixtures?|snapshots?|__snapshots__|__mocks__|testdata|mocks?|helpers?|support|utils?)/"

DOC_NAME = r"(?i)^(readme|changelog|changes|history|contributing|architecture|design|security|code_of_conduct|authors|notice)(\.[a-z]+)?\z"
LICENSE_NAME = r"(?i)^(license|licence|copying)(\.[a-z]+)?\z"
DOC_DIRECTORY = r"(?i)(^|/)(docs?|documentation|adr|adrs|rfcs?)/"
DOC_EXTENSION_IN_DOCS = r"(?i)\.(md|mdx|markdown|rst|adoc|asciidoc|txt)\z"
DOC_EXTENSION = r"(?i)\.(md|mdx|markdown|rst|adoc|asciidoc)\z"
ROOT_README = r"(?i)^readme(\.(md|markdown|rst|txt|adoc))?\z"
DECISION_RECORD = r"(?i)(^|/)(adr|adrs|decisions|decision-records)/[^/]+\.(md|markdown)\z"
ASSISTANT_GUIDE = r"(?i)^(CLAUDE|AGENTS|GEMINI|\.cursorrules|copilot-instructions)(\.md)?\z"
NOTABLE_GUIDES = [
    (r"(?i)^(architecture|design)\.(md|markdown)\z", "architecture notes"),
    (r"(?i)^contributing(\.[a-z]+)?\z", "contribution guidelines"),
    (r"(?i)^(changelog|changes|history)(\.[a-z]+)?\z", "a changelog"),
    (r"(?i)^security(\.[a-z]+)?\z", "a security policy"),
]

CI_SYSTEMS = [
    ("GitHub Actions", r"^\.github/workflows/[^/]+\.ya?ml\z"),
    ("GitLab CI", r"^\.gitlab-ci\.ya?ml\z"),
    ("CircleCI", r"^\.circleci/config\.ya?ml\z"),
    ("Azure Pipelines", r"^azure-pipelines\.ya?ml\z"),
    ("Travis CI", r"^\.travis\.ya?ml\z"),
    ("Bitbucket Pipelines", r"^bitbucket-pipelines\.ya?ml\z"),
    ("Buildkite", r"^\.buildkite/[^/]+\.ya?ml\z"),
    ("Drone CI", r"^\.drone\.ya?ml\z"),
    ("Woodpecker CI", r"^\.woodpecker(\.ya?ml|/[^/]+\.ya?ml)\z"),
    ("Jenkins", r"(^|/)Jenkinsfile\z"),
]

LOCKFILES = [
    "bun.lock", "bun.lockb", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock",
    "pnpm-lock.yaml", "deno.lock", "Cargo.lock", "poetry.lock", "uv.lock", "Pipfile.lock",
    "pdm.lock", "go.sum", "Gemfile.lock", "composer.lock", "mix.lock", "pubspec.lock",
    "Package.resolved", "packages.lock.json", "flake.lock", "gradle.lockfile",
]

VENDORED_PATTERNS = [
    r"(^|/)(node_modules|vendor|third_party|third-party|bower_components|\.yarn)/",
    r"(^|/)(dist|build|out|coverage|target|\.next|\.nuxt|\.svelte-kit)/",
    r"\.min\.(js|css)\z",
    r"\.(map|snap)\z",
]

# Applied to the lower-cased base name.
SENSITIVE_NAME_PATTERNS = [
    r"^\.env(\..*)?\z",
    r"^\.?(npmrc|pypirc|netrc|pgpass|git-credentials|htpasswd)\z",
    r"\.(pem|key|p12|pfx|jks|keystore|kdbx|gpg|asc|ovpn)\z",
    r"^id_(rsa|dsa|ecdsa|ed25519)(\.pub)?\z",
    r"(secret|credential|password|token)s?(\.[a-z0-9]+)?\z",
]
# Applied to the lower-cased path.
SENSITIVE_DIRECTORY = r"(^|/)\.(ssh|aws|gnupg|docker|kube)/"

MANIFEST_NAMES = [
    "package.json", "Cargo.toml", "pyproject.toml", "setup.cfg", "go.mod",
    "CMakeLists.txt", "deno.json", "deno.jsonc",
]
DOTNET_PROJECT = r"\.(csproj|fsproj)\z"

# language, type, extensions
LANGUAGES = [
    ("TypeScript", "programming", ["ts", "tsx", "mts", "cts"]),
    ("JavaScript", "programming", ["js", "jsx", "mjs", "cjs"]),
    ("Python", "programming", ["py", "pyi"]),
    ("Rust", "programming", ["rs"]),
    ("Go", "programming", ["go"]),
    ("Java", "programming", ["java"]),
    ("Kotlin", "programming", ["kt", "kts"]),
    ("Scala", "programming", ["scala"]),
    ("C#", "programming", ["cs"]),
    ("F#", "programming", ["fs", "fsx"]),
    ("C", "programming", ["c", "h"]),
    ("C++", "programming", ["cc", "cpp", "cxx", "hpp", "hh", "hxx"]),
    ("Objective-C", "programming", ["m", "mm"]),
    ("Swift", "programming", ["swift"]),
    ("Ruby", "programming", ["rb"]),
    ("PHP", "programming", ["php"]),
    ("Elixir", "programming", ["ex", "exs"]),
    ("Erlang", "programming", ["erl"]),
    ("Haskell", "programming", ["hs"]),
    ("OCaml", "programming", ["ml", "mli"]),
    ("Clojure", "programming", ["clj", "cljs", "cljc"]),
    ("Dart", "programming", ["dart"]),
    ("Lua", "programming", ["lua"]),
    ("Zig", "programming", ["zig"]),
    ("Nim", "programming", ["nim"]),
    ("Julia", "programming", ["jl"]),
    ("R", "programming", ["r"]),
    ("Shell", "programming", ["sh", "bash", "zsh", "fish"]),
    ("PowerShell", "programming", ["ps1", "psm1"]),
    ("SQL", "programming", ["sql"]),
    ("Vue", "programming", ["vue"]),
    ("Svelte", "programming", ["svelte"]),
    ("Astro", "programming", ["astro"]),
    ("Solidity", "programming", ["sol"]),
    ("GLSL", "programming", ["glsl", "vert", "frag"]),
    ("WGSL", "programming", ["wgsl"]),
    ("HTML", "markup", ["html", "htm"]),
    ("CSS", "markup", ["css"]),
    ("SCSS", "markup", ["scss", "sass"]),
    ("Less", "markup", ["less"]),
    ("JSON", "data", ["json", "jsonc", "json5"]),
    ("YAML", "data", ["yml", "yaml"]),
    ("TOML", "data", ["toml"]),
    ("XML", "data", ["xml"]),
    ("Markdown", "prose", ["md", "mdx", "markdown"]),
    ("reStructuredText", "prose", ["rst"]),
]

SOURCE_ROOTS = [
    "src", "lib", "app", "apps", "packages", "crates", "cmd", "internal", "pkg",
    "source", "sources", "modules", "services",
]

BENCH_DIRECTORY = r"(?i)(^|/)(bench|benches|benchmarks?)/"
BENCH_NAME = r"\.bench\.[cm]?[jt]sx?\z|_bench\.(go|py)\z"

# ---------------------------------------------------------------- fixed values: document selection
MAX_DOCUMENT_BYTES = 262144
MAX_DOCUMENTS = 200
ROOT_TS_CONFIG = r"^(tsconfig|jsconfig)(\.[a-z]+)?\.json\z"
ROOT_LICENSE = r"(?i)^(licen[sc]e|copying)(\.(md|txt))?\z"
DESIGN_DOC = r"(?i)^(architecture|design)\.(md|markdown)\z"
DOCS_ROOT = r"(?i)^(docs?|documentation)/"
MARKDOWN_EXTENSION = r"(?i)\.(md|markdown)\z"

# ---------------------------------------------------------------- fixed values: commit classification
CONVENTIONAL_PREFIX = r"^([a-zA-Z]+)(?:\(([^)]*)\))?(!)?:\s+\S"
AREA_PREFIX = r"^([A-Za-z0-9_][\w./-]{0,40}):\s+(\S.*)\z"
AREA_PREFIX_STRIP = r"^[A-Za-z0-9_][\w./-]{0,40}:\s+"
BREAKING_FOOTER = r"(?m)^BREAKING[ -]CHANGE:"

TYPE_ALIASES = {
    "feat": "feat", "feature": "feat", "fix": "fix", "bugfix": "fix", "hotfix": "fix",
    "docs": "docs", "doc": "docs", "style": "style", "refactor": "refactor", "perf": "perf",
    "test": "test", "tests": "test", "build": "build", "deps": "build", "ci": "ci",
    "chore": "chore", "revert": "revert",
}

KEYWORD_KINDS = [
    (r"(?i)^(fix(ed)? )?typos?\b", "docs"),
    (r"(?i)^(fix|fixed|fixes|fixing|bugfix|hotfix|resolve|resolved|resolves|correct|corrected)\b", "fix"),
    (r"(?i)^revert\b", "revert"),
    (r"(?i)^(release|released|releasing|regenerate[sd]?|misc)\b", "chore"),
    (r"(?i)^(add|added|adds|adding|implement|implemented|implements|introduce|introduced|create|created|support|enable|enabled|start|started)\b", "feat"),
    (r"(?i)^(refactor|refactored|restructure|restructured|rename|renamed|reorganize|reorganized|extract|extracted|simplify|simplified|clean ?up|cleanup|split|move|moved)\b", "refactor"),
    (r"(?i)^(docs?|document|documented|readme)\b", "docs"),
    (r"(?i)^(test|tests|testing)\b", "test"),
    (r"(?i)^(perf|optimize|optimized|optimise|speed up)\b", "perf"),
    (r"(?i)^(bump|upgrade|upgraded|update dependencies|update deps)\b", "build"),
    (r"(?i)^(update[sd]?|upgrade[sd]?)\b.*(\bdeps?\b|dependenc|submodule|\bto v?\d)", "build"),
    (r"(?i)^(format|formatted|lint|reformat|pep ?8)\b", "style"),
]

AUTOMATED_AUTHOR = r"(?i)\[bot\]\z|^(dependabot|renovate|github-actions|greenkeeper|semantic-release-bot|allcontributors|pre-commit-ci|snyk-bot|imgbot|mergify)(\b|\z)"

RELEASE_SUBJECT = r"(?i)^(release\b|bump(ed)? (the )?version|version bump|prepare(s|d)?\b.*\b(release|v?\d+\.\d+)|v?\d+\.\d+\.\d+(-[\w.]+)?\z)"
MINOR_COMMIT_LINES = 5
MINOR_COMMIT_FILES = 2

PROJECT_VERSION = r"(?i)^(?:v|version[-_]?|release[-_]?)?(\d+)\.(\d+)(?:\.(\d+))?(?:[-+._]?([0-9A-Za-z][0-9A-Za-z.-]*))?\z"
PRERELEASE_SUFFIX = r"(?i)^(alpha|beta|rc|pre|preview|dev|canary|next)"

KIND_LABELS = {
    "feat": "Feature work", "fix": "Fixes", "docs": "Documentation", "style": "Code style",
    "refactor": "Refactoring", "perf": "Performance work", "test": "Testing",
    "build": "Build tooling", "ci": "Continuous integration", "chore": "Maintenance",
    "revert": "Reverts", "merge": "Merges", "other": "Development",
}
KIND_NOUNS = {
    "feat": ("feature", "features"), "fix": ("fix", "fixes"),
    "docs": ("documentation change", "documentation changes"),
    "style": ("style change", "style changes"), "refactor": ("refactor", "refactors"),
    "perf": ("performance change", "performance changes"),
    "test": ("test change", "test changes"), "build": ("build change", "build changes"),
    "ci": ("CI change", "CI changes"), "chore": ("chore", "chores"),
    "revert": ("revert", "reverts"), "merge": ("merge", "merges"),
    "other": ("other change", "other changes"),
}
KIND_PRIORITY = ["feat", "fix", "perf", "refactor", "test", "docs", "build", "ci", "chore", "style", "revert", "merge", "other"]

# ---------------------------------------------------------------- fixed values: milestones
MAX_MILESTONES = 12
TOPIC_WEIGHT, KIND_WEIGHT, TIME_WEIGHT, SIZE_WEIGHT, TAG_WEIGHT = 1.0, 0.4, 1.2, 0.8, 1.5
TIME_SATURATION_HOURS = 336
RELATED_GAP_HOURS = 12
RELATED_SIMILARITY = 0.5
CRUMB_COMMITS = 2
CRUMB_SHARE = 0.1
CRUMB_GAP_HOURS = 168
VOLUNTARY_SIZE_CAP = 3
MIN_THEME_WEIGHT = 0.35
MAX_COMMITS_PER_MILESTONE = 12
PLAIN_AREAS = {
    "project root": "top-level files",
    "documentation": "top-level documentation",
    "ci": "CI configuration",
}
MAX_SELECTED_COMMITS = 6

# ---------------------------------------------------------------- fixed values: decisions
DECISION_HEADING = (
    r"(?i)^(?:(?:key|core|main|major|notable|important|design|technical|architecture|architectural|engineering|product|implementation)\s+)*"
    r"(?:decisions?|decision log|choices|trade-?offs|rationale|principles)\z|^why\b.*\?\z"
)
READER_QUESTION = r"(?i)\b(I|you|your)\b"
EXPLICIT_CHOICE_SUBJECTS = [
    r"(?i)^(replace[sd]?|replacing)\b.+\b(with|by)\b",
    r"(?i)^(switch(es|ed)?|switching|migrate[sd]?|migrating)\b.*\b(to|from)\b",
    r"(?i)^(use[sd]?|using|prefer(red|s)?|adopt(ed|s)?|drop(ped|s)?|remove[sd]?|removing)\b.*\b(instead of|in favou?r of|rather than|over)\b",
]
TYPO_WORD = r"(?i)\btypos?\b"
RATIONALE = r"(?i)\b(because|so that|in order to|instead of|rather than|trade-?offs?|decided|we chose|chose to|opted (to|for))\b"
HISTORY_FILE = r"(?i)(^|/)(changelog|changes|history)\."
RANKED_DESIGN_DOC = r"(?i)^(architecture|design)\."
MAX_DECISIONS_PER_DOCUMENT, MAX_DOCUMENT_DECISIONS = 12, 24
MAX_COMMIT_DECISIONS, MAX_TOOLING_DECISIONS = 10, 10
MIGRATION_DISTANCE = 3

# ---------------------------------------------------------------- fixed values: sessions
CHOICE_PHRASE = r"(?i)\b(decided to|decide to|the decision (is|was)|chose|chosen|opted (to|for)|went with|going with|settled on|in favou?r of|trade-?offs?|(we|I)('ll| will| are going to| am going to) (use|go with|keep|switch to|stick with))\b"
COMPARISON_PHRASE = r"(?i)\b(instead of|rather than)\b"
ACTION_WORD = r"(?i)\b(use[sd]?|using|keep|kept|switch(ed)?|prefer(red)?|pick(ed)?|adopt(ed)?|replace[sd]?|store[sd]?|build|built|pass|generate[sd]?)\b"
DEBUGGING_PHRASE = r"(?i)\b(root cause|the (bug|issue|problem|failure) (was|is)|caused by|turned out|a regression|regression (in|from|introduced))\b"
MAX_SESSION_DECISIONS, MAX_DECISIONS_PER_EVENT, MAX_DEBUGGING_NOTES = 12, 2, 5
MAX_SESSION_BYTES = 26214400
MAX_EVENT_TEXT = 20000
CONTAINER_KEYS = ["messages", "events", "entries", "items", "conversation", "turns", "log", "history", "transcript", "records", "data", "chat_messages"]
CONTAINER_DEPTH = 2
ID_KEYS = ["id", "uuid", "event_id", "eventId", "message_id", "messageId"]
ROLE_KEYS = ["role", "speaker", "sender", "from"]
TIME_KEYS = ["timestamp", "time", "created_at", "createdAt", "date", "datetime", "ts"]
CONTENT_KEYS = ["content", "text", "message", "body", "value", "prompt", "response", "summary"]
OUTPUT_KEYS = ["output", "result", "stdout", "stderr"]
KNOWN_ROLES = ["user", "human", "assistant", "ai", "model", "system", "tool", "developer"]
ROLE_WORDS = "user|human|me|assistant|ai|claude|codex|gpt|chatgpt|copilot|model|system|tool|developer"
ASSISTANT_WORDS = ["ai", "claude", "codex", "gpt", "chatgpt", "copilot", "model"]
TIMESTAMP_IN_LINE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"
SHELL_NAMES = "bash|sh|shell|console|zsh|fish|terminal|powershell|pwsh|ps1?|cmd"
# Test-runner summary lines, tried in this order.  Java dialect (multi-line, dot-all parts).
TEST_SUMMARY_PATTERNS = {
    "pass_fail": r"(?m)^\s*(\d+) pass\b(?s:.*?)^\s*(\d+) fail\b",
    "pytest": r"=+ ((?:\d+ (?:passed|failed|skipped|errors?|xfailed|xpassed)(?:, )?)+) in [\d.]+s",
    "cargo": r"test result: (ok|FAILED)\. (\d+) passed; (\d+) failed",
    "jest": r"(?m)^Tests:\s+(.+total)\s*$",
    "vitest": r"(?m)^\s*Tests\s+(\d+ (?:passed|failed).*?)\s*$",
    "go": r"(?m)^(ok|FAIL)\s+\S+\s+[\d.]+s",
}

# ---------------------------------------------------------------- fixed values: commands
PURPOSES = [
    ("test", r"\b(bun test|deno test|(npm|pnpm|yarn|bun)( run)? test|vitest|jest|mocha|playwright test|cypress run|pytest|tox|nox|cargo (test|nextest)|go test|dotnet test|ctest|mvn (-\S+ )*(test|verify)|gradlew? (test|check)|rspec|phpunit|mix test|flutter test|swift test)\b"),
    ("typecheck", r"\b(tsc|vue-tsc|svelte-check|mypy|pyright|cargo check|flow check|deno check)\b"),
    # Java dialect: the linter pattern looks ahead.
    ("lint", r"\b(eslint|biome (check|lint|ci)|ruff check|ruff\b(?! format)|flake8|pylint|clippy|golangci-lint|go vet|rubocop|stylelint|shellcheck|hadolint|markdownlint|(npm|pnpm|yarn|bun)( run)? lint)\b"),
    ("format", r"\b(prettier (--check|-c)|biome format|ruff format --check|black --check|cargo fmt|gofmt|rustfmt --check|dotnet format)\b"),
    ("build", r"\b((npm|pnpm|yarn|bun)( run)? build|bun build|cargo build|go build|dotnet (build|publish)|cmake --build|mvn (-\S+ )*package|gradlew? (build|assemble)|docker build|vite build|next build|tsc (-b|--build))"),
    ("coverage", r"(--coverage|--cov\b|coverage run|cargo (tarpaulin|llvm-cov)|nyc\b|c8\b)"),
    ("benchmark", r"\b(bench|benchmark|hyperfine)\b"),
    ("audit", r"\b((npm|pnpm|yarn) audit|cargo (audit|deny)|pip-audit|safety check|govulncheck|trivy|snyk)\b"),
]
TARGET_PURPOSES = [
    ("test", r"^(tests?|check|unit|integration|e2e)([-_].*)?\z|[-_]tests?\z"),
    ("coverage", r"cover(age)?"),
    ("lint", r"^(lint|codestyle|style|flake8|pylint|ruff|clippy|vet)([-_].*)?\z"),
    ("format", r"^(fmt|format)([-_].*)?\z"),
    ("typecheck", r"^(typecheck|type-check|types|mypy|pyright)\z"),
    ("build", r"^(build|dist|package|compile|all)\z"),
]
PURPOSE_LABELS = {
    "test": "tests", "typecheck": "type checking", "lint": "linting", "format": "formatting",
    "build": "a build", "coverage": "coverage", "benchmark": "benchmarks", "audit": "dependency auditing",
}
SCRIPT_RUN = r"^(?:npm|pnpm|yarn|bun)(?:\s+run)?\s+([A-Za-z0-9:_-]+)"
MAX_EXPANDED_SCRIPTS = 10
MAKE_RUN = r"^(?:g?make|just)\s+(.*)\z"
# Java dialect: here-document with its body, closed by the same word.
HEREDOC = r"<<-?\s*(['\"]?)([A-Za-z_]\w*)\1[^\n]*\n[\s\S]*?\n\s*\2\s*(?=\n|\z)"
SHELL_PLUMBING = r"^(set\s+[-+]|git\s+(config|add|commit|push|pull|fetch|checkout|diff|status|remote|reset)\b|echo\b|printf\b|cd\b|export\b|if\b|then\b|else\b|elif\b|fi\b|for\b|do\b|done\b|while\b|exit\b|mkdir\b|[{}]|\[\[?\s)"

# ---------------------------------------------------------------- fixed values: engineering practice
STRICT_FLAGS = [
    "strict", "noUncheckedIndexedAccess", "exactOptionalPropertyTypes", "noImplicitOverride",
    "noImplicitReturns", "noFallthroughCasesInSwitch", "noPropertyAccessFromIndexSignature",
    "noUnusedLocals", "noUnusedParameters",
]
LINT_TOOLS = ["ESLint", "Biome", "Prettier", "Ruff", "golangci-lint", "rustfmt", "Clippy", "EditorConfig", "pre-commit", "Husky"]
AREA_ORDER = ["testing", "ci", "types", "linting", "build", "benchmarks", "documentation", "release", "process", "session"]
TECHNOLOGY_KIND_ORDER = ["language", "runtime", "framework", "library", "package-manager", "build-system", "tool", "platform"]
EVIDENCE_LEVELS = ["observed", "documented", "inferred"]
PYPROJECT_TOOLS = ["pytest.ini_options", "ruff", "mypy", "black", "pyright", "coverage.run", "isort", "hatch"]
SETUP_CFG_TOOLS = ["tool:pytest", "mypy", "flake8", "isort"]
UNSAFE_CHARACTERS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\u202a-\u202e\u2066-\u2069]"

# ---------------------------------------------------------------- fixed values: tool markers
# name, kind, group, match, values.  Matches: base (base name is one of), path (whole path is
# one of), stem (base name is the stem or starts with "stem."), base_re / path_re (pattern),
# prefix / suffix (of the path).
MARKERS = [
    ("Bun", "runtime", "js-package-manager", "base", ["bun.lock", "bun.lockb", "bunfig.toml"]),
    ("pnpm", "package-manager", "js-package-manager", "base", ["pnpm-lock.yaml", "pnpm-workspace.yaml"]),
    ("Yarn", "package-manager", "js-package-manager", "base", ["yarn.lock", ".yarnrc.yml"]),
    ("npm", "package-manager", "js-package-manager", "base", ["package-lock.json", "npm-shrinkwrap.json"]),
    ("Deno", "runtime", None, "base", ["deno.json", "deno.jsonc", "deno.lock"]),
    ("Node.js", "runtime", None, "path", [".nvmrc", ".node-version"]),
    ("TypeScript", "language", None, "base_re", [r"^tsconfig(\.[\w-]+)?\.json\z"]),
    ("Cargo", "build-system", None, "base", ["Cargo.toml"]),
    ("Go modules", "build-system", None, "base", ["go.mod"]),
    ("Poetry", "package-manager", "py-package-manager", "base", ["poetry.lock"]),
    ("uv", "package-manager", "py-package-manager", "base", ["uv.lock"]),
    ("Pipenv", "package-manager", "py-package-manager", "base", ["Pipfile", "Pipfile.lock"]),
    ("pip requirements", "package-manager", "py-package-manager", "base_re", [r"^requirements([-.\w]*)?\.txt\z"]),
    ("setuptools", "build-system", None, "base", ["setup.py", "setup.cfg"]),
    (".NET", "platform", None, "path_re", [r"\.(csproj|fsproj|vbproj|sln)\z"]),
    ("CMake", "build-system", None, "base", ["CMakeLists.txt"]),
    ("Make", "build-system", None, "path", ["Makefile", "makefile", "GNUmakefile"]),
    ("Meson", "build-system", None, "base", ["meson.build"]),
    ("Bazel", "build-system", None, "base", ["BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel", "MODULE.bazel"]),
    ("Gradle", "build-system", None, "base", ["build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"]),
    ("Maven", "build-system", None, "base", ["pom.xml"]),
    ("Bundler", "package-manager", None, "base", ["Gemfile"]),
    ("Composer", "package-manager", None, "base", ["composer.json"]),
    ("Mix", "build-system", None, "base", ["mix.exs"]),
    ("Swift Package Manager", "build-system", None, "base", ["Package.swift"]),
    ("Dart pub", "package-manager", None, "base", ["pubspec.yaml"]),
    ("Nix", "tool", None, "path", ["flake.nix", "default.nix", "shell.nix"]),
    ("Docker", "platform", None, "base_re", [r"^(Dockerfile|Containerfile)(\..+)?\z|\.dockerfile\z|^(docker-)?compose\.ya?ml\z"]),
    ("Terraform", "tool", None, "suffix", [".tf"]),
    ("Helm", "tool", None, "base", ["Chart.yaml"]),
    ("Vite", "tool", "js-bundler", "stem", ["vite.config"]),
    ("Webpack", "tool", "js-bundler", "stem", ["webpack.config"]),
    ("Rollup", "tool", "js-bundler", "stem", ["rollup.config"]),
    ("Next.js", "framework", None, "stem", ["next.config"]),
    ("Nuxt", "framework", None, "stem", ["nuxt.config"]),
    ("SvelteKit", "framework", None, "stem", ["svelte.config"]),
    ("Astro", "framework", None, "stem", ["astro.config"]),
    ("Tailwind CSS", "library", None, "stem", ["tailwind.config"]),
    ("Vitest", "tool", "js-test-runner", "stem", ["vitest.config", "vitest.workspace"]),
    ("Jest", "tool", "js-test-runner", "stem", ["jest.config"]),
    ("Playwright", "tool", None, "stem", ["playwright.config"]),
    ("Cypress", "tool", None, "stem", ["cypress.config"]),
    ("pytest", "tool", None, "base", ["pytest.ini", "conftest.py"]),
    ("tox", "tool", None, "base", ["tox.ini"]),
    ("ESLint", "tool", "js-linter", "base_re", [r"^(eslint\.config\.[cm]?[jt]s|\.eslintrc(\.[a-z]+)?)\z"]),
    ("Biome", "tool", "js-linter", "base", ["biome.json", "biome.jsonc"]),
    ("Prettier", "tool", None, "base_re", [r"^(\.prettierrc(\.[a-z]+)?|prettier\.config\.[cm]?js)\z"]),
    ("Ruff", "tool", None, "base", ["ruff.toml", ".ruff.toml"]),
    ("golangci-lint", "tool", None, "base_re", [r"^\.golangci\.(ya?ml|toml|json)\z"]),
    ("rustfmt", "tool", None, "base", ["rustfmt.toml", ".rustfmt.toml"]),
    ("Clippy", "tool", None, "base", ["clippy.toml", ".clippy.toml"]),
    ("EditorConfig", "tool", None, "path", [".editorconfig"]),
    ("pre-commit", "tool", None, "path", [".pre-commit-config.yaml"]),
    ("Husky", "tool", None, "prefix", [".husky/"]),
    ("Renovate", "tool", None, "path_re", [r"^(\.github/)?renovate\.json5?\z"]),
    ("Dependabot", "tool", None, "path", [".github/dependabot.yml", ".github/dependabot.yaml"]),
    ("Storybook", "tool", None, "prefix", [".storybook/"]),
    ("Prisma", "library", None, "suffix", ["schema.prisma"]),
] + [(name, "platform", "ci", "path_re", [pattern]) for name, pattern in CI_SYSTEMS]

# ---------------------------------------------------------------- fixed values: dependency rules
# ecosystem -> rows of (dependency, or a prefix written with a final "*"; technology; kind).
DEPENDENCY_RULES = {
    "npm": [
        ("react", "React", "framework"), ("next", "Next.js", "framework"), ("vue", "Vue", "framework"),
        ("nuxt", "Nuxt", "framework"), ("svelte", "Svelte", "framework"), ("@sveltejs/kit", "SvelteKit", "framework"),
        ("solid-js", "SolidJS", "framework"), ("@angular/core", "Angular", "framework"), ("astro", "Astro", "framework"),
        ("@remix-run/*", "Remix", "framework"), ("react-native", "React Native", "framework"), ("expo", "Expo", "platform"),
        ("electron", "Electron", "platform"), ("express", "Express", "framework"), ("fastify", "Fastify", "framework"),
        ("hono", "Hono", "framework"), ("koa", "Koa", "framework"), ("elysia", "Elysia", "framework"),
        ("@nestjs/core", "NestJS", "framework"), ("typescript", "TypeScript", "language"), ("@types/bun", "Bun", "runtime"),
        ("bun-types", "Bun", "runtime"), ("vite", "Vite", "tool"), ("webpack", "Webpack", "tool"),
        ("esbuild", "esbuild", "tool"), ("rollup", "Rollup", "tool"), ("tsup", "tsup", "tool"),
        ("turbo", "Turborepo", "tool"), ("nx", "Nx", "tool"), ("tailwindcss", "Tailwind CSS", "library"),
        ("vitest", "Vitest", "tool"), ("jest", "Jest", "tool"), ("mocha", "Mocha", "tool"),
        ("@playwright/test", "Playwright", "tool"), ("cypress", "Cypress", "tool"), ("@testing-library/*", "Testing Library", "tool"),
        ("eslint", "ESLint", "tool"), ("prettier", "Prettier", "tool"), ("@biomejs/biome", "Biome", "tool"),
        ("@prisma/client", "Prisma", "library"), ("prisma", "Prisma", "library"), ("drizzle-orm", "Drizzle ORM", "library"),
        ("mongoose", "Mongoose", "library"), ("zod", "Zod", "library"), ("graphql", "GraphQL", "library"),
        ("@trpc/server", "tRPC", "library"), ("three", "three.js", "library"), ("d3", "D3", "library"),
        ("socket.io", "Socket.IO", "library"), ("@tanstack/react-query", "TanStack Query", "library"),
        ("@reduxjs/toolkit", "Redux", "library"), ("redux", "Redux", "library"),
    ],
    "deno": [],
    "cargo": [
        ("tokio", "Tokio", "library"), ("serde", "Serde", "library"), ("axum", "Axum", "framework"),
        ("actix-web", "Actix Web", "framework"), ("rocket", "Rocket", "framework"), ("clap", "clap", "library"),
        ("bevy", "Bevy", "framework"), ("tauri", "Tauri", "framework"), ("wasm-bindgen", "wasm-bindgen", "library"),
        ("reqwest", "reqwest", "library"), ("sqlx", "SQLx", "library"), ("diesel", "Diesel", "library"),
        ("criterion", "Criterion", "tool"), ("proptest", "proptest", "tool"),
    ],
    "python": [
        ("django", "Django", "framework"), ("flask", "Flask", "framework"), ("fastapi", "FastAPI", "framework"),
        ("numpy", "NumPy", "library"), ("pandas", "pandas", "library"), ("torch", "PyTorch", "library"),
        ("tensorflow", "TensorFlow", "library"), ("scikit-learn", "scikit-learn", "library"), ("pydantic", "Pydantic", "library"),
        ("sqlalchemy", "SQLAlchemy", "library"), ("click", "Click", "library"), ("typer", "Typer", "library"),
        ("streamlit", "Streamlit", "framework"), ("pytest", "pytest", "tool"), ("mypy", "mypy", "tool"),
        ("ruff", "Ruff", "tool"), ("black", "Black", "tool"),
    ],
    "go": [
        ("github.com/gin-gonic/gin", "Gin", "framework"), ("github.com/labstack/echo*", "Echo", "framework"),
        ("github.com/gofiber/fiber*", "Fiber", "framework"), ("github.com/go-chi/chi*", "chi", "library"),
        ("github.com/spf13/cobra", "Cobra", "library"), ("gorm.io/gorm", "GORM", "library"),
        ("google.golang.org/grpc", "gRPC", "library"), ("github.com/stretchr/testify", "Testify", "tool"),
    ],
    "dotnet": [
        ("Microsoft.AspNetCore*", "ASP.NET Core", "framework"), ("Microsoft.EntityFrameworkCore*", "Entity Framework Core", "library"),
        ("xunit*", "xUnit", "tool"), ("NUnit*", "NUnit", "tool"), ("MSTest*", "MSTest", "tool"),
    ],
    "cmake": [
        ("GTest", "GoogleTest", "tool"), ("Catch2", "Catch2", "tool"), ("Qt5", "Qt", "framework"), ("Qt6", "Qt", "framework"),
        ("Boost", "Boost", "library"), ("SDL2", "SDL2", "library"), ("OpenGL", "OpenGL", "library"), ("Vulkan", "Vulkan", "library"),
    ],
}
