"""Declarative recipes: where a page keeps its postings, as data instead of code.

A recipe names a container, one for each posting, and for each field the rules that are tried in
turn inside it: a selector, what to take of the first element found (`text`, `own` for text that isn't in
elements inside it, or an attribute), and a pattern whose group is the value. Values that match `skip`, or don't match
`match`, are passed over, as are empty ones where either is given; `nth` takes a later one, `join` all from there on; `lead`
is put before what was found. A rule with `every` gives all elements' values as a list. `within` makes the block
the nearest ancestor of the container that it names, `up` one so many levels up. Blocks without title or url are no postings. Relative links are resolved against the page's own address.

Recipes are checked once on the driver (they are few: one a source) and sent to the tasks; a page
meets the recipe of its source, is parsed once and gives its rows, all in one pass without a
shuffle. `replay` runs two versions of the recipes over the stored pages in such a pass.

Selectors are a part of CSS: names, `*`, `#id`, `.class`, `[attr]` with = ~= |= ^= $= *=, `:first-child`,
`:last-child`, `:nth-child(n)`, `:not(one of these)`, the combinators and commas; a rule's `:scope` is the
block itself. Others raise when the recipe is checked. Markup is read as it stands: elements that aren't closed end with their
parent, end tags without a start are passed over, script, style and template have no text.

Defined results: a null or broken page, and a source without a recipe, give no rows. A null address
leaves links as they are. A pattern that isn't found, or has no such group, makes the value empty,
and the next rule is tried. All other columns stay; new ones are named by the caller.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fields of a posting, and those it can't be without.
FIELDS = ("title", "url", "company", "location")
REQUIRED = ("title", "url")
#: Elements that hold nothing, and those whose content isn't text.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MUTE = {"script", "style", "template"}
#: The selector of a rule that takes from the block itself.
SCOPE = ":scope"


@dataclass(frozen=True)
class Rule:
    selector: str
    take: str = "text"
    regex: str | None = None
    group: int = 0
    every: bool = False
    skip: str | None = None
    match: str | None = None
    nth: int = 0
    join: str | None = None
    lead: str = ""


@dataclass(frozen=True)
class Recipe:
    source: str
    container: str
    fields: Mapping[str, tuple[Rule, ...]]
    up: int = 0
    within: str | None = None


@dataclass(frozen=True)
class Aliases:
    """More names of a board's fields and of its list of postings, tried after the known ones."""

    source: str
    title: tuple[str, ...] = ()
    url: tuple[str, ...] = ()
    arrays: tuple[str, ...] = ()


def _only(data: Mapping, allowed: set[str], what: str) -> None:
    if not isinstance(data, Mapping):
        raise ValueError(f"{what} must be a mapping")
    if other := set(data) - allowed:
        raise ValueError(f"{what} has unknown keys {sorted(other)}")


def _rule(name: str, data: Mapping) -> Rule:
    _only(data, {"selector", "attr", "regex", "group", "every", "skip", "match", "nth", "join", "lead"}, f"rule of {name}")
    more = {k: data[k] for k in ("skip", "match", "nth", "join", "lead") if k in data}
    rule = Rule(data.get("selector", ""), data.get("attr", ""), data.get("regex"), data.get("group", 0), bool(data.get("every", False)), **more)
    if not rule.selector or not rule.take:
        raise ValueError(f"rule of {name} needs a selector and attr")
    if rule.selector != SCOPE:
        selectors(rule.selector)
    for pattern in filter(None, (rule.regex, rule.skip, rule.match)):
        re.compile(pattern)
    if not all(isinstance(n, int) and n >= 0 for n in (rule.group, rule.nth)):
        raise ValueError(f"rule of {name}: group and nth must be numbers")
    if rule.every and name in FIELDS:
        raise ValueError(f"{name} is one value, not a list")
    return rule


def checked(surface: str, data: Mapping) -> Recipe | Aliases:
    """The recipe of a mapping, for surface email, careers or ats; whatever is wrong with it raises ValueError."""
    if surface == "ats":
        _only(data, {"source", "title_fields", "url_fields", "array_keys"}, "recipe")
        lists = [data.get(k, []) for k in ("title_fields", "url_fields", "array_keys")]
        if not all(isinstance(x, list) and all(isinstance(n, str) and n for n in x) for x in lists) or not any(lists):
            raise ValueError("aliases are lists of names, at least one of them not empty")
        return Aliases(data.get("source", ""), *map(tuple, lists))
    if surface not in ("email", "careers"):
        raise ValueError(f"unknown surface {surface!r}")
    _only(data, {"source", "container_selector", "fields", "up", "within"}, "recipe")
    fields = data.get("fields")
    if not data.get("container_selector") or not isinstance(fields, Mapping):
        raise ValueError("a recipe needs container_selector and fields")
    if missing := [f for f in REQUIRED if f not in fields]:
        raise ValueError(f"fields lack {missing}")
    for text in filter(None, (data["container_selector"], data.get("within"))):
        selectors(text)
    rules = {n: tuple(_rule(n, r) for r in (f if isinstance(f, list) else [f])) for n, f in fields.items()}
    for name, own in rules.items():
        if not own or len({r.every for r in own}) > 1:
            raise ValueError(f"rules of {name} are none, or some for one value and some for a list")
        if name not in FIELDS and not own[0].every:
            raise ValueError(f"unknown field {name}; further ones must be lists")
    return Recipe(data.get("source", ""), data["container_selector"], rules, int(data.get("up", 0)), data.get("within"))


def as_mapping(recipe: Recipe) -> dict:
    """What `checked` makes the same recipe of."""
    rule = lambda r: {"attr" if k == "take" else k: v for k, v in asdict(r).items()}
    return {"source": recipe.source, "container_selector": recipe.container, "up": recipe.up, "within": recipe.within, "fields": {n: [rule(r) for r in rules] for n, rules in recipe.fields.items()}}


class Page(HTMLParser):
    """The elements of a page in document order; the ones inside element i are those from i + 1 to before end[i]."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.attrs, self.parents, self.end = [""], [{}], [-1], [0]
        self._texts, self._at = [], []  # (parent, text), and how many elements had begun by then
        self._open = [0]
        self.feed(html)
        self.close()
        while self._open:
            self._shut()
        self._children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parents):
            self._children.setdefault(p, []).append(i)

    def _shut(self) -> None:
        self.end[self._open.pop()] = len(self.names)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.names.append(tag)
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.attrs.append(own)
        self.parents.append(self._open[-1])
        self.end.append(len(self.names))
        if tag not in _VOID:
            self._open.append(len(self.names) - 1)

    def handle_endtag(self, tag: str) -> None:
        if any(self.names[i] == tag for i in self._open):
            while self.names[self._open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data: str) -> None:
        self._texts.append((self._open[-1], data))
        self._at.append(len(self.names))

    def siblings(self, i: int) -> list[int]:
        return self._children[self.parents[i]]

    def text(self, i: int) -> str:
        """The trimmed texts inside element i, joined."""
        a, b = bisect_right(self._at, i), bisect_right(self._at, self.end[i])
        return "".join(t.strip() for p, t in self._texts[a:b] if i <= p < self.end[i] and (p == i or self.names[p] not in _MUTE))

    def own_text(self, i: int) -> str:
        """The trimmed texts of element i alone, joined."""
        a, b = bisect_right(self._at, i), bisect_right(self._at, self.end[i])
        return "".join(t.strip() for p, t in self._texts[a:b] if p == i)

    def select(self, test: Callable[[Page, int], bool], inside: int = 0) -> Iterator[int]:
        return (i for i in range(inside + 1, self.end[inside]) if test(self, i))


_PART = re.compile(
    r"""(?P<name>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<klass>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<v>[\w-]+))\s*)?\]"""
    r"""|:(?P<pseudo>first-child|last-child|nth-child\(\s*(?P<nth>\d+)\s*\)|not\((?P<inner>[^()]+)\))""",
    re.X,
)
_OPS = {
    "=": lambda have, v: have == v,
    "~=": lambda have, v: v in have.split(),
    "|=": lambda have, v: have == v or have.startswith(f"{v}-"),
    "^=": lambda have, v: v != "" and have.startswith(v),
    "$=": lambda have, v: v != "" and have.endswith(v),
    "*=": lambda have, v: v != "" and v in have,
}


def _test(m: re.Match) -> Callable[[Page, int], bool]:
    """The test of one simple selector."""
    if name := m["name"]:
        return lambda page, i: name in ("*", page.names[i]) if name == "*" else page.names[i] == name.lower()
    if m["id"]:
        return lambda page, i: page.attrs[i].get("id") == m["id"]
    if m["klass"]:
        return lambda page, i: m["klass"] in page.attrs[i].get("class", "").split()
    if m["attr"]:
        key, value = m["attr"].lower(), next((m[g] for g in ("q", "a", "v") if m[g] is not None), "")
        if not m["op"]:
            return lambda page, i: key in page.attrs[i]
        return lambda page, i: key in page.attrs[i] and _OPS[m["op"]](page.attrs[i][key], value)
    if m["inner"]:
        inner = _compound(m["inner"].strip())
        return lambda page, i: not inner(page, i)
    place = {"first-child": 0, "last-child": -1}.get(m["pseudo"], int(m["nth"] or 0) - 1)
    if m["nth"] == "0":
        return lambda page, i: False
    return lambda page, i: (s := page.siblings(i)) and -len(s) <= place < len(s) and s[place] == i


def _compound(text: str) -> Callable[[Page, int], bool]:
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["name"] and at):
            raise ValueError(f"selector {text!r} isn't understood from {text[at:]!r}")
        tests.append(_test(m))
        at = m.end()
    if not tests:
        raise ValueError("an empty selector")
    return lambda page, i: all(t(page, i) for t in tests)


def _before(page: Page, i: int, combinator: str) -> Iterator[int]:
    """The elements that stand to i as the combinator says."""
    if combinator in (" ", ">"):
        p = page.parents[i]
        while p > 0:
            yield p
            p = page.parents[p] if combinator == " " else 0
    else:
        own = page.siblings(i)
        k = own.index(i)
        yield from reversed(own[:k] if combinator == "~" else own[max(0, k - 1) : k])


def _chain(steps: Sequence[tuple[str, Callable[[Page, int], bool]]]) -> Callable[[Page, int], bool]:
    """steps: (combinator to what stands before, test), left to right."""
    combinator, test = steps[-1]
    if len(steps) == 1:
        return test
    rest = _chain(steps[:-1])
    return lambda page, i: test(page, i) and any(rest(page, j) for j in _before(page, i, combinator))


def _split(text: str, marks: str) -> Iterator[tuple[str, str]]:
    """(mark before, part) at marks outside brackets and quotes."""
    depth, quote, mark, part = 0, "", "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif not depth and c in marks:
            yield mark, part
            mark, part = c, ""
            continue
        part += c
    yield mark, part


def selectors(text: str) -> Callable[[Page, int], bool]:
    """Whether an element is one of those that a list of selectors names."""
    chains = []
    for _, one in _split(text, ","):
        steps, wanted = [], " "
        for mark, part in _split(one.strip(), " \t\n>+~"):
            if mark.strip():
                if not steps or wanted.strip():
                    raise ValueError(f"selector {text!r} has a combinator without an element")
                wanted = mark
            if part:
                steps.append((wanted, _compound(part)))
                wanted = " "
        if not steps or wanted.strip():
            raise ValueError(f"selector {text!r} ends without an element")
        chains.append(_chain(steps))
    return lambda page, i: any(c(page, i) for c in chains)


def _value(page: Page, i: int, rule: Rule) -> str:
    """What a rule makes of an element; empty if it is passed over."""
    value = page.text(i) if rule.take == "text" else page.own_text(i) if rule.take == "own" else page.attrs[i].get(rule.take, "")
    if (rule.skip and re.search(rule.skip, value)) or (rule.match and not re.search(rule.match, value)):
        return ""
    if rule.regex and value:
        m = re.search(rule.regex, value)
        value = (m.group(rule.group) or "") if m and rule.group <= (m.re.groups) else ""
    return rule.lead + value if value else ""


class Extractor:
    """A recipe ready to run."""

    def __init__(self, recipe: Recipe) -> None:
        self.container, self.up = selectors(recipe.container), recipe.up
        self.within = selectors(recipe.within) if recipe.within else None
        self.rules = {n: [(r, None if r.selector == SCOPE else selectors(r.selector)) for r in rules] for n, rules in recipe.fields.items()}

    def _values(self, page: Page, block: int, rule: Rule, test: Callable[[Page, int], bool] | None) -> Iterator[str]:
        return (_value(page, i, rule) for i in ([block] if test is None else page.select(test, block)))

    def _one(self, page: Page, block: int, name: str) -> str:
        for rule, test in self.rules.get(name, ()):
            values = self._values(page, block, rule, test)
            if rule.skip or rule.match or rule.nth or rule.join is not None:
                values = islice(filter(None, values), rule.nth, None)
            value = rule.join.join(values) if rule.join is not None else next(values, "")
            if value:
                return value
        return ""

    def _many(self, page: Page, block: int, name: str) -> list[str]:
        for rule, test in self.rules[name]:
            if values := [v for v in self._values(page, block, rule, test) if v]:
                return values
        return []

    def __call__(self, page: Page, base: str | None) -> list[dict]:
        """place, the fields (None where empty) and the lists of each posting."""
        out = []
        for block in page.select(self.container):
            while self.within is not None and block > 0 and not self.within(page, block):
                block = page.parents[block]
            for _ in range(self.up):
                block = max(0, page.parents[block])
            if block <= 0:
                continue
            row = {n: self._one(page, block, n) or None for n in FIELDS}
            if all(row[n] for n in REQUIRED):
                row["url"] = _joined(base, row["url"])
                out.append(row | {"place": len(out), "lists": [(n, self._many(page, block, n)) for n in self.rules if n not in FIELDS]})
        return out


def _joined(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:  # an address that isn't one
        return link


def _parsed(html: str | None) -> Page | None:
    try:
        return Page(html) if html else None
    except (AssertionError, ValueError):  # what the parser can't make sense of
        return None


_POSTING = pa.struct([("place", pa.int32()), *((n, pa.string()) for n in FIELDS), ("lists", pa.map_(pa.string(), pa.list_(pa.string())))])
POSTING = "struct<place:int,title:string,url:string,company:string,location:string,lists:map<string,array<string>>>"


def _applied(pages: DataFrame, versions: Sequence[Mapping[str, Recipe]], source: Column, html: Column, base: Column, schema: str, kind: pa.DataType, of: Callable[[list[list[dict]]], object]) -> DataFrame:
    """The pages (as struct `page`) with their source `s` and `found`, made of what each version finds there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [{k: Extractor(r) for k, r in version.items()} for version in versions]
        for batch in batches:
            found = []
            for src, text, address in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                page = _parsed(text) if any(src in version for version in ready) else None
                found.append(of([version[src](page, address) if page is not None and src in version else [] for version in ready]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["page", "s", "found"])

    rows = pages.select(F.struct(*pages.columns).alias("page"), source.cast("string").alias("s"), html.cast("string").alias("h"), base.cast("string").alias("b"))
    return rows.mapInArrow(run, StructType([rows.schema["page"], StructField("s", StringType()), *StructType.fromDDL(f"found {schema}").fields]))


def first_found(pages: DataFrame, layouts: Sequence[Mapping[str, Recipe]], source: Column, html: Column, base: Column, name: str = "posting") -> DataFrame:
    """As extract, with several recipes a source: of a page, the first that finds anything counts. Postings that repeat a url and title on a page count once."""

    def first(versions: list[list[dict]]) -> list[dict]:
        seen: dict[tuple, dict] = {}
        for row in next(filter(None, versions), []):
            seen.setdefault((row["url"], row["title"]), row)
        return [row | {"place": i} for i, row in enumerate(seen.values())]

    found = _applied(pages, layouts, source, html, base, f"array<{POSTING}>", pa.list_(_POSTING), first)
    return found.select("page.*", F.explode("found").alias(name))


def extract(pages: DataFrame, recipes: Mapping[str, Recipe], source: Column, html: Column, base: Column, name: str = "posting") -> DataFrame:
    """The pages' columns and each posting as a struct (place, the fields, lists), one row a posting."""
    found = _applied(pages, [recipes], source, html, base, f"array<{POSTING}>", pa.list_(_POSTING), lambda versions: versions[0])
    return found.select("page.*", F.explode("found").alias(name))


def replay(pages: DataFrame, present: Mapping[str, Recipe], candidates: Mapping[str, Recipe], source: Column, html: Column, base: Column) -> DataFrame:
    """What the candidates would change on stored pages, one row a source that has one.

    pages, both, lost (pages with postings before and none now), won (the other way), neither, rows_before and rows_after.
    verdict: `regression` if a page is lost, else `target_unfixed` if one that had none has none still,
    else `equal` if no page's rows differ, else `accepted`. Only counts are gathered, so a source may hold any share of the pages.
    """
    own = pages.where(source.cast("string").isin(list(candidates)))
    kind = pa.struct([("n", pa.int64()), ("m", pa.int64()), ("same", pa.bool_())])
    counted = _applied(own, [present, candidates], source, html, base, "struct<n:long,m:long,same:boolean>", kind, lambda v: {"n": len(v[0]), "m": len(v[1]), "same": v[0] == v[1]})
    n, m = F.col("found.n"), F.col("found.m")
    sums = counted.groupBy(F.col("s").alias("source")).agg(
        F.count("*").alias("pages"), F.count_if((n > 0) & (m > 0)).alias("both"), F.count_if((n > 0) & (m == 0)).alias("lost"),
        F.count_if((n == 0) & (m > 0)).alias("won"), F.count_if((n == 0) & (m == 0)).alias("neither"),
        F.sum(n).alias("rows_before"), F.sum(m).alias("rows_after"), F.bool_and("found.same").alias("same"),
    )
    verdict = F.when(F.col("lost") > 0, "regression").when(F.col("neither") > 0, "target_unfixed").when(F.col("same"), "equal").otherwise("accepted")
    return sums.withColumn("verdict", verdict).drop("same")
