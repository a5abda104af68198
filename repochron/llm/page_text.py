"""Main text of web pages with wrappers inferred from the pages of the same host.

A page is read as a stream of container tags and text blocks.  A wrapper is a regular
expression without unions: tags, texts, text slots, optional items and repeated groups.  It
starts as the stream of one page, with tandem repeats folded into groups; every further page
is aligned with it, and mismatches become slots (texts that differ), optional items (blocks
that one side lacks) or repeated groups (a unit that one side holds several times).

Each task folds the pages of a host into one wrapper, and the partial wrappers of a host meet
in two rounds, salted in the first, so no task reads the pages of a large host.  What stays
constant over different pages is template text, whatever its length and also as one member of a
repeated group whose other members differ (texts are compared by 64-bit hashes); blocks of a container full of links, and
those in menus, headers, footers, sidebars, notices, adverts, forms and comments, are not
content either.  If the wrapper has an article, only what lies inside it is.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.llm.common import stage
from repochron.llm.urls import host_of

_TOKEN = re.compile(
    r"([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|(<)", re.S)
#: elements whose content is no markup; it goes with them
_RAW = set("script style noscript template svg iframe textarea select object video audio canvas title math".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt s samp small span strike strong sub sup time tt u var wbr input meta link base".split())
_LEAF = set("p li dt dd td th tr h1 h2 h3 h4 h5 h6 option caption figcaption summary".split())
_VOID = {"br", "hr"}
_OUTSIDE = set("nav footer aside form menu dialog button fieldset head".split())
_MAIN = {"article", "main"}
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|sidenav|aside|notice|cookie|cookies|consent|banner|ad|ads|adv|advert|adverts|advertisement|"
    r"sponsor|sponsored|promo|comment|comments|reply|replies|discussion|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|widget|popup|"
    r"modal|overlay|newsletter|subscribe|signup|login|search|toolbar|topbar|copyright|legal|alert|contentinfo|complementary|form|skip)(?:$|[-_\s0-9])", re.I)

#: a text is template text if it stayed the same over so many merges of pages that differed
TEMPLATE_MERGES = 3
#: hosts that a task holds wrappers of before it passes them on
HELD_HOSTS = 2000
SALTS = 16


class Block:
    """A text block: place (containers and leaf tag), text, characters in links, and its surroundings."""

    __slots__ = ("place", "text", "linked", "outside", "main")

    def __init__(self, place: str, text: str, linked: int, outside: bool, main: bool):
        self.place, self.text, self.linked, self.outside, self.main = place, text, linked, outside, main


def stream(page: str) -> list[str | Block]:
    """Container tags (``<key`` and ``/key``) and text blocks of a page in order."""
    out: list[str | Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, key, outside, main
    leaf, words, linked, links = "", [], 0, 0

    def close_block() -> None:
        nonlocal words, linked
        if not words:
            return
        text = " ".join("".join(words).split())
        if text:
            place = ">".join(s[1] for s in stack) + ">" + leaf
            out.append(Block(place, text, linked, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))
        words, linked = [], 0

    at, end, match = 0, len(page), _TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        text = m[1] or m[8]
        if text:
            if "&" in text:
                text = entities.unescape(text)
            words.append(text)
            if links:
                linked += len(text)
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, rest = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name in _INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        close_block()
        if name in _RAW:
            if not closing and not rest.endswith("/"):
                at = _RAW_END[name].search(page, at).end()
            continue
        if name in _VOID:
            continue
        if name in _LEAF:
            leaf = "" if closing else name
            continue
        leaf = ""
        if closing:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if found >= 0:
                for _, key, _, _ in reversed(stack[found:]):
                    out.append("/" + key)
                del stack[found:]
            continue
        if rest.endswith("/"):
            continue
        attributes = [(a[0].lower(), a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(rest)] if rest else []
        named = " ".join(v for _, v in attributes)
        above = stack[-1] if stack else ("", "", False, False)
        main = above[3] or name in _MAIN
        outside = above[2] or name in _OUTSIDE or (name == "header" and not main) or (bool(named) and name not in ("html", "body") and name not in _MAIN and bool(_NAMES.search(named))) or bool(rest and _HIDDEN.search(rest))
        key = name + "".join("." + v.split()[0] for a, v in attributes if a == "class" and v.split())
        if name in ("html", "body"):
            key = name
        stack.append((name, key, outside, main))
        out.append("<" + key)
    close_block()
    return out


# A wrapper item: [key, optional, texts, unit].  texts of a text item: [literal to show or None,
# merges, pages, characters, linked characters, outside, main, constants]; constants: sorted hashes
# of the texts that every page with the item has there, several in a group; unit: the items of a
# repeated group.

def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _items(tokens: list[str | Block]) -> list[list]:
    return [[t, 0, None, None] if isinstance(t, str) else ["#" + t.place, 0, [t.text if len(t.text) <= 200 else t.text[:199] + "…", 0, 1, len(t.text), t.linked, int(t.outside), int(t.main), [_hash(t.text)]], None] for t in tokens]


def _merge_item(a: list, b: list, beside: bool = False) -> list:
    """One item of two: of different pages, or ``beside`` each other in the same ones."""
    optional = a[1] or b[1]
    if a[3] is not None:
        return [a[0], optional, None, [_merge_item(x, y, beside) for x, y in zip(a[3], b[3], strict=True)]]
    if a[2] is None:
        return [a[0], optional, None, None]
    x, y = a[2], b[2]
    same = x[7] == y[7]
    constants = x[7] if same else sorted(set(x[7]) | set(y[7]) if beside else set(x[7]) & set(y[7]))
    # all constants of items beside each other were on so many pages at least
    merges, on = (min(x[1], y[1]), min(x[2], y[2])) if beside else (x[1] + y[1], x[2] + y[2])
    return [a[0], optional, [x[0] if same and x[0] == y[0] else None, merges, on, x[3] + y[3], x[4] + y[4], x[5], x[6], constants], None]


def _balanced(unit: list[list]) -> bool:
    depth = 0
    for item in unit:
        depth += 1 if item[0][0] == "<" else -1 if item[0][0] == "/" else 0
        if depth < 0:
            return False
    return depth == 0


def _group(unit: list[list]) -> list:
    return ["(" + " ".join(i[0] for i in unit) + ")+", 0, None, unit]


def fold(items: list[list], longest: int = 8) -> list[list]:
    """Tandem repeats of balanced units become repeated groups, short units first."""
    for size in range(1, longest + 1):
        keys, out, i = [x[0] for x in items], [], 0
        while i < len(items):
            n = 1
            if size <= len(items) - i and keys[i][0] != "(" and keys[i:i + size] == keys[i + size:i + 2 * size] and _balanced(items[i:i + size]):
                unit = items[i:i + size]
                while keys[i + n * size:i + (n + 1) * size] == keys[i:i + size]:
                    unit = [_merge_item(a, b, True) for a, b in zip(unit, items[i + n * size:i + (n + 1) * size], strict=True)]
                    n += 1
                out.append(_group(unit))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _fold_known(items: list[list], units: dict[str, list[list]]) -> list[list]:
    """Single occurrences of units that the other side repeats become groups as well."""
    if not units:
        return items
    shapes = sorted({tuple(i[0] for i in unit) for unit in units.values()}, key=len, reverse=True)
    keys, out, i = [x[0] for x in items], [], 0
    while i < len(items):
        shape = next((s for s in shapes if tuple(keys[i:i + len(s)]) == s), None)
        if shape:
            out.append(_group(items[i:i + len(shape)]))
            i += len(shape)
        else:
            out.append(items[i])
            i += 1
    return out


def _joined(items: list[list]) -> list[list]:
    """Equal groups that stand next to each other are one."""
    out: list[list] = []
    for item in items:
        if out and item[3] is not None and out[-1][0] == item[0]:
            out[-1] = _merge_item(out[-1], item, True)
        else:
            out.append(item)
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers."""
    if [x[0] for x in a] != [x[0] for x in b]:
        groups = lambda s: {x[0]: x[3] for x in s if x[3] is not None}
        units = groups(a) | groups(b)
        a, b = _joined(_fold_known(a, units)), _joined(_fold_known(b, units))
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka == kb:
        return [_merge_item(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    optional = lambda x: [x[0], 1, x[2], x[3]]
    for m in SequenceMatcher(None, ka, kb, autojunk=False).get_matching_blocks():
        out += map(optional, a[i:m.a])
        out += map(optional, b[j:m.b])
        out += [_merge_item(x, y) for x, y in zip(a[m.a:m.a + m.size], b[m.b:m.b + m.size], strict=True)]
        i, j = m.a + m.size, m.b + m.size
    return out


def _texts(items: list[list]) -> Iterator[list]:
    for item in items:
        if item[3] is not None:
            yield from _texts(item[3])
        elif item[2] is not None:
            yield item


def _count_merge(items: list[list], other: list[list]) -> list[list]:
    """Aligns, and counts a merge for every text if the two sides differ in some text."""
    before = [t[2][7] for t in _texts(items)] != [t[2][7] for t in _texts(other)]
    out = align(items, other)
    if before:
        for t in _texts(out):
            t[2][1] += 1
    return out


def expression(items: list[list]) -> str:
    """The wrapper as a readable regular expression."""
    show = lambda x: ("(" + " ".join(map(show, x[3])) + ")+" if x[3] is not None else x[0] if x[2] is None else x[0].rsplit(">", 1)[-1] + ("#PCDATA" if x[2][0] is None else repr(x[2][0]))) + ("?" if x[1] else "")
    return " ".join(map(show, items))


def content_rules(items: list[list]) -> dict:
    """What the wrapper says about blocks: template texts, places full of links, and whether it has an article."""
    chars: dict[str, list[int]] = {}
    fixed, article = [], False
    for key, _, t, _ in _texts(items):
        place = key[1:]
        total = chars.setdefault(place, [0, 0])
        total[0] += t[3]
        total[1] += t[4]
        article |= bool(t[6] and not t[5])
        if t[1] >= TEMPLATE_MERGES and t[2] > TEMPLATE_MERGES:
            fixed += [f"{place}\n{h}" for h in t[7]]
    return {"article": article, "fixed": fixed, "links": [p for p, (n, linked) in chars.items() if 2 * linked > n]}


def extract(page: str | None, rules: dict) -> str:
    """The content blocks of a page, joined by one space."""
    if not page:
        return ""
    blocks = [b for b in stream(page) if isinstance(b, Block) and not b.outside]
    inside = [b for b in blocks if b.main]
    if inside and rules["article"]:
        blocks = inside
    fixed, links = set(rules["fixed"]), set(rules["links"])
    return " ".join(b.text for b in blocks if not (b.place in links and not b.main) and not (fixed and f"{b.place}\n{_hash(b.text)}" in fixed))


def infer_wrappers(pages: DataFrame, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, n_pages, wrapper): one wrapper for each host, from all its pages, as JSON items.

    Pages without html are not counted; pages without a host share the empty host.
    """
    source = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).cast("string").alias("html")).filter("html <> ''")
    schema = "host string, n_pages long, wrapper string"

    def rows(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([json.dumps(h[1]) for h in held.values()], pa.string())], ["host", "n_pages", "wrapper"])

    def add(held: dict[str, list], host: str, n: int, items: list[list]) -> None:
        old = held.get(host)
        held[host] = [n, items] if old is None else [old[0] + n, _count_merge(old[1], items)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                add(held, host.as_py(), 1, fold(_items(stream(page.as_py()))))
            if len(held) > HELD_HOSTS:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def meet(table: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for row in table.sort_by("wrapper").to_pylist():
            add(held, row["host"], row["n_pages"], json.loads(row["wrapper"]))
        return pa.Table.from_batches([rows(held)])

    parts = source.mapInArrow(over, schema)
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt"))
    return salted.applyInArrow(meet, schema).groupBy("host").applyInArrow(meet, schema)


def extract_main_text(pages: DataFrame, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` with (text, n_chars): the main text of every row.

    A null or empty html gives an empty text.  A null URL belongs to the empty host.  Repeated
    pages have equal texts and say nothing about what is template.  A host of one page is read
    by its tags alone.  An empty table gives an empty result.  Columns of ``pages`` named ``text``
    or ``n_chars`` are replaced.
    """
    pages = pages.drop("text", "n_chars")
    rules = F.udf(lambda w: json.dumps(content_rules(json.loads(w))), "string")
    # written first, so that its size is known when the join is planned
    per_host = stage(infer_wrappers(pages, url_column=url_column, html_column=html_column).select(F.col("host").alias("_host"), rules("wrapper").alias("_rules")))
    joined = pages.join(per_host, host_of(F.col(url_column)) == F.col("_host"), "left").drop("_host")
    at, last = pages.columns.index(html_column), len(pages.columns)
    none = {"article": True, "fixed": [], "links": []}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                if rule and rule not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(extract(page, known[rule] if rule else none))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:last], "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return joined.mapInArrow(over, f"{schema}, text string, n_chars long")
