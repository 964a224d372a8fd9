"""Element selection on raw pages: one tokenising pass per page inside an Arrow UDF.

The pass only finds elements and their text. Everything relational about the result (which
alternative wins, order, de-duplication, url resolution) is done by Spark on the returned array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from serialake.rules import Rule

_INT, _TEXT = T.IntegerType(), T.StringType()
FOUND = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in (
    ("field", _TEXT), ("container_rank", _INT), ("rank", _INT), ("scope", _INT), ("nth", _INT), ("pos", _INT), ("tag", _TEXT),
    ("text", _TEXT), ("href", _TEXT), ("value", _TEXT), ("title", _TEXT), ("list_classes", _TEXT))]))
_FOUND_ARROW = pa.list_(pa.struct([(f.name, pa.int32() if f.dataType == _INT else pa.string()) for f in FOUND.elementType.fields]))
SLICE = 64  # pages whose elements are Python objects at the same time
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SELF_CLOSING_SIBLINGS = {"li", "option", "tr", "p"}
_SIMPLE = re.compile(r"""(?P<tag>^[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)["']?(?P<val>[^"'\]]*)["']?)?\]""")


@lru_cache(maxsize=4096)
def _chains(selector: str) -> tuple:
    """``"a.x > b, c"`` as alternatives of (tests, must-be-parent) steps, innermost first."""
    chains = []
    for alternative in selector.split(","):
        steps, direct = [], False
        for token in alternative.replace(">", " > ").split():
            if token == ">":
                direct = True
                continue
            tests = []
            for m in _SIMPLE.finditer(token):
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower(), None))
                elif m["cls"]:
                    tests.append(("class", m["cls"], None))
                elif m["id"]:
                    tests.append(("=", "id", m["id"]))
                else:
                    tests.append((m["op"] or "has", m["attr"], m["val"]))
            steps.append((tuple(tests), direct))
            direct = False
        chains.append(tuple(reversed(steps)))
    return tuple(chains)


def _passes(element: dict, tests: tuple) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = element["tag"] == name
        elif kind == "class":
            ok = name in element["classes"]
        else:
            have = element["attrs"].get(name)
            ok = have is not None and (
                kind == "has" or (kind == "=" and have == value) or (kind == "^=" and have.startswith(value))
                or (kind == "*=" and value in have) or (kind == "$=" and have.endswith(value)))
        if not ok:
            return False
    return True


def _matches(stack: list[dict], index: int, chain: tuple, step: int = 0) -> bool:
    tests, direct = chain[step]
    if not _passes(stack[index], tests):
        return False
    if step + 1 == len(chain):
        return True
    above = range(index - 1, max(index - 2, -1), -1) if direct else range(index - 1, -1, -1)
    return any(_matches(stack, i, chain, step + 1) for i in above)


@lru_cache(maxsize=4096)
def _by_mark(rules: tuple, noise: tuple) -> dict:
    """What every selector stands for, by one mark that its innermost step asks for (None: any element).

    A mark is a class, an attribute or the tag. An entry is a chain, the selector, and its roles: is it noise, a container, the child
    that makes its parent a container, and the places of its rules.
    """
    containers = {r[3] for r in rules if r[3]}
    selectors = dict.fromkeys([*noise, *[c[8:-1] if c.startswith(":parent(") else c for c in sorted(containers)], *[r[1] for r in rules]])
    index = {}
    for selector in selectors:
        parent = f":parent({selector})"
        roles = (selector in noise, selector if selector in containers else None, parent if parent in containers else None,
                 tuple(i for i, r in enumerate(rules) if r[1] == selector))
        for chain in _chains(selector):
            asked = {kind if kind in ("tag", "class") else "attr": name for kind, name, _ in chain[0][0]} if chain else {}
            mark = next(((kind, asked[kind]) for kind in ("class", "attr", "tag") if kind in asked), None)
            index.setdefault(mark, []).append((chain, selector, roles))
    return index


class _Walker(HTMLParser):
    def __init__(self, rules: Sequence[tuple], noise: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.rules, self.by_mark = rules, _by_mark(tuple(rules), tuple(noise))
        self.stack, self.found, self.counts, self.seq = [], [], {}, 0

    def handle_starttag(self, tag, attrs):
        if tag in _SELF_CLOSING_SIBLINGS and self.stack and self.stack[-1]["tag"] == tag:
            self._pop()
        attributes = {k: v or "" for k, v in attrs}
        element = {"tag": tag, "attrs": attributes, "classes": set(attributes.get("class", "").split()), "seq": self.seq,
                   "in": set(), "parts": [], "open": []}
        self.seq += 1
        self.stack.append(element)
        top = len(self.stack) - 1
        noise, seen, places = top > 0 and self.stack[top - 1]["noise"], set(), []
        for mark in (None, ("tag", tag), *[("class", c) for c in element["classes"]], *[("attr", a) for a in attributes]):
            for chain, selector, (is_noise, container, parent, rules) in self.by_mark.get(mark, ()):
                if selector in seen or not _matches(self.stack, top, chain):
                    continue
                seen.add(selector)
                noise = noise or is_noise
                places += rules
                if container:
                    element["in"].add(container)
                if parent and top > 0:
                    self.stack[top - 1]["in"].add(parent)
        element["noise"] = noise
        if not noise:
            for i in sorted(places):
                field, _, rank, container, container_rank = self.rules[i]
                self._record(element, field, rank, container, container_rank)
        if tag in _VOID:
            self._pop()

    def _record(self, element, field, rank, container, container_rank):
        scope = -1
        if container:
            inside = [e["seq"] for e in self.stack[:-1] if container in e["in"]]
            if not inside:
                return
            scope = inside[-1]
        key = (field, rank, container_rank, scope)
        nth = self.counts.get(key, 0)
        self.counts[key] = nth + 1
        lists = [" ".join(sorted(e["classes"])) for e in self.stack[:-1] if e["tag"] == "ul"]
        attrs = element["attrs"]
        row = {"field": field, "container_rank": container_rank, "rank": rank, "scope": scope, "nth": nth, "pos": element["seq"],
               "tag": element["tag"], "text": "", "href": attrs.get("href"), "title": attrs.get("title"),
               "value": next((attrs[a] for a in ("data-base64", "content", "value", "src", "data-last", "data-value") if attrs.get(a)), None),
               "list_classes": lists[-1] if lists else None}
        self.found.append(row)
        element["open"].append((row, []))

    def handle_data(self, data):
        if not self.stack or self.stack[-1]["noise"]:
            return
        code = self.stack[-1]["tag"] in ("script", "style")
        stripped = data.strip()
        if stripped:
            for element in self.stack:
                if element["open"] and (not code or element is self.stack[-1]):
                    for _, parts in element["open"]:
                        parts.append(stripped)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        element = self.stack.pop()
        for row, parts in element["open"]:
            row["text"] = "\n".join(parts)
        return element["tag"]

    def finish(self) -> list[dict]:
        self.close()
        while self.stack:
            self._pop()
        return self.found


def walk(html: str | None, rules: Sequence[tuple], noise: Sequence[str]) -> list[dict]:
    if not html or not rules:
        return []
    walker = _Walker(rules, noise)
    walker.feed(html)
    return walker.finish()


def plain_rules(rules: Sequence[Rule]) -> tuple:
    return tuple((r.field, r.selector, r.rank, r.container, r.container_rank) for r in rules)


def slices(batch) -> Iterator:
    """An Arrow batch or array in pieces of ``SLICE`` rows."""
    return (batch.slice(at, SLICE) for at in range(0, len(batch), SLICE))


def _walked(walk_one, *columns: pa.Array) -> pa.Array:
    """Elements of every page of a batch, made slice by slice, so that only a slice's elements are Python objects."""
    made = [pa.array([walk_one(*row) for row in zip(*[c.to_pylist() for c in some])], _FOUND_ARROW) for some in zip(*map(slices, columns))]
    return pa.concat_arrays(made) if made else pa.array([], _FOUND_ARROW)


def find_elements(html: Column, rules: Sequence[Rule], noise: Sequence[str] = ("script", "style")) -> Column:
    """Elements of each page that match ``rules``, in page order; text parts are joined by newlines."""
    plain, noise = plain_rules(rules), tuple(noise)

    @arrow_udf(FOUND)
    def find(pages: pa.Array) -> pa.Array:
        return _walked(lambda page: walk(page, plain, noise), pages)

    return find(html)


def find_elements_by_row(html: Column, rules: Column, noise: Sequence[str] = ("script", "style")) -> Column:
    """Same, with the rules of each page in a column (``array<rule>``): per-site and profile rules."""
    noise = tuple(noise)

    def plain(rows) -> tuple:
        return tuple((r["field"], r["selector"], r["rank"], r["container"], r["container_rank"]) for r in rows) if rows is not None else ()

    @arrow_udf(FOUND)
    def find(pages: pa.Array, rule_rows: pa.Array) -> pa.Array:
        return _walked(lambda page, rows: walk(page, plain(rows), noise), pages, rule_rows)

    return find(html, rules)


def plugin(df, extract, schema: str):
    """K1, plainest form: ``extract(arrow_batches) -> arrow_batches`` applied to every partition (``plugins`` chooses by site)."""
    return df.mapInArrow(extract, schema)


def of_field(found: Column, field: str) -> Column:
    return F.filter(found, lambda e: e["field"] == field)


def best_rank(found: Column) -> Column:
    """Only the elements of the best (lowest) rank present.

    Elements and rank are bound once: a lambda evaluates its body, with all that stands in it, for every element.
    """
    ranked = lambda some, best: F.filter(some, lambda e: e["rank"] == best)
    lowest = lambda some: F.array(F.array_min(F.transform(some, lambda e: e["rank"])))
    return F.transform(F.array(found), lambda some: F.transform(lowest(some), lambda best: ranked(some, best))[0])[0]


def first_text(found: Column, field: str) -> Column:
    """Text of the first element of the best rank, null when absent."""
    winner = F.array_min(F.transform(of_field(found, field), lambda e: F.struct(e["rank"], e["pos"], e["text"], e["value"], e["href"])))
    return F.nullif(winner["text"], F.lit(""))


def first_value(found: Column, field: str) -> Column:
    """Attribute value of the first element that has one, by rank then position."""
    carried = F.filter(of_field(found, field), lambda e: e["value"].isNotNull())
    return F.array_min(F.transform(carried, lambda e: F.struct(e["rank"], e["pos"], e["value"])))["value"]
