"""Recipes, their replay, bodies, names of a dictionary and stored payloads, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hirelake.functions import blocks, content
from hirelake.operators import gazetteer
from hirelake.sources import captures, feeds, recipes

# recipes

TAGS = ["div", "ul", "li", "a", "p", "h2", "span"]


def grow(r, depth=0):
    """A random tree: (name, attrs, children), children being trees or texts."""
    attrs = {}
    if r.random() < 0.4:
        attrs["class"] = " ".join(r.sample(["x", "y", "job"], r.randint(1, 2)))
    if r.random() < 0.3:
        attrs["href"] = r.choice(["/a", "b?c=1", "https://o.org/z", "/a-b"])
    if r.random() < 0.2:
        attrs["id"] = r.choice(["one", "two"])
    kids = [r.choice(["t ", " u", " "]) if r.random() < 0.3 else grow(r, depth + 1) for _ in range(r.randint(0, 4 if depth < 4 else 0))]
    return (r.choice(TAGS), attrs, kids)


def markup(tree):
    if isinstance(tree, str):
        return tree
    name, attrs, kids = tree
    return f"<{name}{''.join(f' {k}="{v}"' for k, v in attrs.items())}>{''.join(map(markup, kids))}</{name}>"


def walk(tree, path=()):
    """Every element in order with its ancestors: ((tree, its number among its siblings, number of siblings, siblings before), ...)."""
    name, _, kids = tree
    own = [k for k in kids if not isinstance(k, str)]
    for i, k in enumerate(own):
        here = (*path, (k, i, len(own), own[:i]))
        yield here
        yield from walk(k, here)


def has(node, name=None, klass=None, attr=None, begins=None):
    n, attrs, _ = node
    return (name is None or n == name) and (klass is None or klass in attrs.get("class", "").split()) and (attr is None or attr in attrs) and (begins is None or attrs.get("href", "").startswith(begins))


#: Selectors, and the same by hand on a path of (node, number, of so many, those before).
BY_HAND = {
    "li": lambda p: has(p[-1][0], "li"),
    "*.x": lambda p: has(p[-1][0], klass="x"),
    "DIV.job, a[href]": lambda p: has(p[-1][0], "div", "job") or has(p[-1][0], "a", attr="href"),
    "ul li": lambda p: has(p[-1][0], "li") and any(has(x[0], "ul") for x in p[:-1]),
    "ul > li.x": lambda p: has(p[-1][0], "li", "x") and len(p) > 1 and has(p[-2][0], "ul"),
    "div p > a": lambda p: has(p[-1][0], "a") and len(p) > 1 and has(p[-2][0], "p") and any(has(x[0], "div") for x in p[:-2]),
    "h2 + p": lambda p: has(p[-1][0], "p") and bool(p[-1][3]) and has(p[-1][3][-1], "h2"),
    "h2 ~ p": lambda p: has(p[-1][0], "p") and any(has(x, "h2") for x in p[-1][3]),
    "li:first-child": lambda p: has(p[-1][0], "li") and p[-1][1] == 0,
    "li:last-child": lambda p: has(p[-1][0], "li") and p[-1][1] == p[-1][2] - 1,
    "li:nth-child(2)": lambda p: has(p[-1][0], "li") and p[-1][1] == 1,
    "a:not(.x)": lambda p: has(p[-1][0], "a") and not has(p[-1][0], klass="x"),
    'a[href^="/"]': lambda p: has(p[-1][0], "a", attr="href", begins="/"),
    "[class~=y]": lambda p: "y" in p[-1][0][1].get("class", "").split(),
    "#one span": lambda p: has(p[-1][0], "span") and any(x[0][1].get("id") == "one" for x in p[:-1]),
}


def test_selectors_against_walker():
    r = random.Random(5)
    hits = dict.fromkeys(BY_HAND, 0)
    for _ in range(120):
        tree = ("", {}, [grow(r) for _ in range(3)])
        page = recipes.Page("".join(map(markup, tree[2])))
        paths = list(walk(tree))
        assert [p[-1][0][0] for p in paths] == page.names[1:]
        for text, test in BY_HAND.items():
            want = [i + 1 for i, p in enumerate(paths) if test(p)]
            assert list(page.select(recipes.selectors(text))) == want, text
            hits[text] += len(want)

        def text_of(node):
            parts = []  # texts beside each other are one
            for k in node[2]:
                if isinstance(k, str) and parts and parts[-1][0]:
                    parts[-1] = (True, parts[-1][1] + k)
                else:
                    parts.append((True, k) if isinstance(k, str) else (False, text_of(k)))
            return "".join(p.strip() if own else p for own, p in parts)

        assert [page.text(i + 1) for i in range(len(paths))] == [text_of(p[-1][0]) for p in paths]
    assert all(hits.values())


def test_broken_markup():
    page = recipes.Page('<ul><li>one<li>two</ul></b><p>x<br>y<script>var a = "<li>";</script></p><!-- <li> --><img src=a>')
    assert page.names[1:] == ["ul", "li", "li", "p", "br", "script", "img"]
    assert page.text(page.names.index("p")) == "xy" and page.text(1) == "onetwo"
    assert page.text(page.names.index("script")) == 'var a = "<li>";'


GOOD = {"source": "s", "container_selector": "li", "fields": {"title": {"selector": "a", "attr": "text"}, "url": {"selector": "a", "attr": "href"}}}


@pytest.mark.parametrize(
    "change",
    [
        {"extra": 1}, {"container_selector": ""}, {"container_selector": "li >"}, {"container_selector": "li:hover"}, {"container_selector": "> li"}, {"fields": {}}, {"fields": None},
        {"fields": {"title": GOOD["fields"]["title"]}}, {"fields": {**GOOD["fields"], "pay": {"selector": "b", "attr": "text"}}}, {"fields": {**GOOD["fields"], "title": []}},
        {"fields": {**GOOD["fields"], "title": {"selector": "a", "attr": "text", "every": True}}}, {"fields": {**GOOD["fields"], "title": {"selector": "a", "attr": "text", "odd": 1}}},
        {"fields": {**GOOD["fields"], "title": "a"}}, {"fields": {**GOOD["fields"], "title": {"selector": "a", "attr": ""}}}, {"fields": {**GOOD["fields"], "title": {"selector": "a", "attr": "text", "regex": "("}}},
        {"fields": {**GOOD["fields"], "title": {"selector": "a", "attr": "text", "group": -1}}},
    ],
)
def test_recipes_are_checked(change):
    recipes.checked("careers", GOOD)
    with pytest.raises((ValueError, re.error)):
        recipes.checked("careers", {**GOOD, **change})


def test_recipe_schema():
    made = recipes.checked("email", GOOD)
    assert recipes.checked("email", recipes.as_mapping(made)) == made
    with pytest.raises(ValueError):
        recipes.checked("board", GOOD)
    assert recipes.checked("ats", {"source": "ats:x", "title_fields": ["t"]}) == recipes.Aliases("ats:x", ("t",))
    for bad in ({}, {"title_fields": []}, {"title_fields": [""]}, {"title_fields": "t"}, {"url_fields": [1]}, {"other": ["x"]}):
        with pytest.raises(ValueError):
            recipes.checked("ats", bad)


PAGE = """<div class=job><h2>Dev</h2><a href="/j/1">go</a><i>Rome</i><b>x</b><b>y</b></div><div class=job><h3> Ops (m/f) </h3><a href="https://o.org/2">go</a></div>
<div class=job><h2>No link</h2></div><div class=job><h2></h2><h3>Fallback</h3><a href="3?q=1"></a></div>"""
RECIPE = recipes.checked(
    "careers",
    {
        "source": "s", "container_selector": "div.job",
        "fields": {
            "title": [{"selector": "h2", "attr": "text"}, {"selector": "h3", "attr": "text", "regex": r"^(\w+)", "group": 1}], "url": {"selector": "a", "attr": "href"},
            "location": {"selector": "i", "attr": "text"}, "company": {"selector": "a", "attr": "text", "regex": "(x)|go", "group": 1}, "tags": {"selector": "b", "attr": "text", "every": True},
        },
    },
)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "s", PAGE, "https://h.org/a/b"), (2, "s", None, None), (3, "other", PAGE, ""), (4, None, PAGE, ""), (5, "s", "", ""), (6, "s", PAGE, None)], "found int, page string, html string, url string")
    got = recipes.extract(pages, {"s": RECIPE}, F.col("page"), F.col("html"), F.col("url"))
    assert got.columns == ["found", "page", "html", "url", "posting"]
    rows = [(r.found, r.posting.place, r.posting.title, r.posting.url, r.posting.company, r.posting.location, r.posting.lists) for r in got.collect()]
    first = [(1, 0, "Dev", "https://h.org/j/1", None, "Rome", {"tags": ["x", "y"]}), (1, 1, "Ops", "https://o.org/2", None, None, {"tags": []}), (1, 2, "Fallback", "https://h.org/a/3?q=1", None, None, {"tags": []})]
    assert [r for r in rows if r[0] == 1] == first
    assert [(r[0], r[3]) for r in rows if r[0] != 1] == [(6, "/j/1"), (6, "https://o.org/2"), (6, "3?q=1")]
    assert recipes.extract(pages.limit(0), {"s": RECIPE}, F.col("page"), F.col("html"), F.col("url")).count() == 0


def test_replay(spark):
    def of(container):
        return recipes.checked("careers", {**GOOD, "container_selector": container})

    li, p = '<li><a href="/1">x</a></li>', '<p><a href="/2">y</a></p>'
    pages = spark.createDataFrame([("a", li), ("a", li), ("b", li), ("b", p), ("c", li), ("c", "none"), ("d", li + li), ("e", None), ("z", li)], "s string, html string")
    present = {k: of("li") for k in "abcd"}
    new = {"a": of("*:not(p)"), "b": of("p"), "c": of("li"), "d": of("li:first-child"), "e": of("li")}
    new["a"] = of("li.x, li")
    got = {r.source: r for r in recipes.replay(pages, present, new, F.col("s"), F.col("html"), F.lit(None)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a": "equal", "b": "regression", "c": "target_unfixed", "d": "accepted", "e": "target_unfixed"}
    assert (got["b"].lost, got["b"].won, got["b"].both, got["c"].neither, got["d"].rows_before, got["d"].rows_after) == (1, 1, 0, 1, 2, 1)


def test_alias_recipes(spark):
    docs = spark.createDataFrame([('{"vacancies": [{"headline": "Dev", "company": "A", "where_to": "u"}, {"title": "Known", "headline": "x", "company": "B"}]}',), ('{"jobs": [{"headline": "Ops", "company": "C"}]}',), (None,)], "doc string")
    recipe = recipes.checked("ats", {"source": "ats:x", "title_fields": ["headline", "title"], "url_fields": ["where_to"], "array_keys": ["vacancies"]})
    assert sorted((r.title, r.url or "") for r in feeds.aliased(docs, recipe).collect()) == [("Dev", "u"), ("Known", ""), ("Ops", "")]
    assert feeds.postings(feeds.objects(docs, "doc")).count() == 0


# bodies

def test_best_run_against_all_runs(spark):
    r = random.Random(6)
    rows = [[r.randint(-9, 9) for _ in range(r.randint(0, 12))] for _ in range(300)]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, w array<int>").select("i", blocks.best_run(F.col("w")).alias("r")).collect()
    for x in got:
        w = rows[x.i]
        every = [(-sum(w[a : b + 1]), b, -a) for a in range(len(w)) for b in range(a, len(w)) if sum(w[a : b + 1]) > 0]
        want = min(every, default=None)
        assert (x.r and (-x.r.total, x.r.last, -x.r.first)) == want


def test_blocks_and_body(spark):
    text = " ".join(f"w{i}" for i in range(30))
    html = f'<head><title>no</title></head><nav><a href=x>Home page</a> <a href=y>Jobs</a></nav><div>{text}</div><script>if (a<b) x</script><p>{text} &amp; <a href=z>more</a></p><footer>a b</footer>'
    row = spark.createDataFrame([(html,), (None,), ("",), ("<a>only links here</a>",)], "h string").select(blocks.blocks(F.col("h")).alias("b"))
    row = row.withColumn("r", blocks.best_run(F.transform("b", lambda b: blocks.weight(b)))).select("b", "r", blocks.body(F.col("b"), F.col("r")).alias("body")).collect()
    assert [(b.text[:9], b.words, b.linked) for b in row[0].b] == [("Home page", 3, 3), ("w0 w1 w2 ", 30, 0), ("w0 w1 w2 ", 32, 1), ("a b", 2, 0)]
    assert row[0].body == f"{text}\n{text} & more" and [x.body for x in row[1:]] == [None] * 3


def test_json_or(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("nope",), (None,), ("",), ("null",), ('{"b": 2}',)], "t string")
    got = [r[0] for r in rows.select(content.json_or(F.col("t"), "a int", F.struct(F.lit(9).alias("a")))["a"]).collect()]
    assert got == [1, 9, 9, 9, 9, 9, None]


# names

def plain_mentions(text, names):
    w, at, out = re.findall(r"[^\W_]+", (text or "").lower()), 0, []
    while at < len(w):
        n = next((n for n in (4, 3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in names), 0)
        if n:
            out.append((at, " ".join(w[at : at + n])))
        at += n or 1
    return out


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_mentions_against_plain(spark, bytes_):
    r = random.Random(7)
    words = ["new", "york", "city", "port", "of", "spain", "san"]
    entries = [(" ".join(r.choice(words) for _ in range(r.randint(1, 5))), r.choice(["US", "GB", None]), r.choice([None, 1, 5, 5, 9]), i) for i in range(60)] + [("", "US", 1, 98), (None, "US", 1, 99)]
    table = spark.createDataFrame(entries, "name string, land string, population int, id int")
    names = gazetteer.dictionary(table)
    texts = [(i, " ".join(r.choice([*words, "x", "-"]) for _ in range(r.randint(0, 25)))) for i in range(80)] + [(100, None), (101, "")]
    got = {}
    for m in gazetteer.mentions(spark.createDataFrame(texts, "k int, t string"), "k", F.col("t"), names, broadcast_bytes=bytes_).collect():
        got.setdefault(m.k, []).append((m["at"], m.run))
    short = {n for n, *_ in entries if n and len(n.split()) <= 4}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in texts if (v := plain_mentions(t, short))}

    def best(own):
        return min(own, key=lambda e: (-(-1 if e[2] is None else e[2]), e[0] or "", e[1] or "", -1 if e[2] is None else e[2], e[3]))[3]

    rows = names.select("run", gazetteer.chosen(F.col("choices"))["thing"]["id"].alias("largest"), gazetteer.chosen(F.col("choices"), F.lit("GB"))["thing"]["id"].alias("gb"), gazetteer.chosen(F.col("choices"), home="US")["thing"]["id"].alias("home")).collect()
    for x in rows:
        own = [e for e in entries if e[0] == x.run]
        sized = lambda some: {e[3] for e in some if (e[2] or -1) == max((y[2] or -1) for y in some)}
        assert x.largest in sized(own)
        gb, us = [e for e in own if e[1] == "GB"], [e for e in own if e[1] == "US"]
        assert (x.gb is None) == (not gb) and (not gb or x.gb in sized(gb)) and x.home in sized(us or own)


def test_hints(spark):
    names = gazetteer.dictionary(spark.createDataFrame([("New York", "US", 9), ("New", "GB", 1), ("Paris", "US", 1), ("Paris", "FR", 9)], "name string, land string, population int"))
    urls = ["https://x.org/jobs/new-york-data-analyst-12", "https://x.org/New_12_york/?a=b/paris", "/careers/paris", "https://x.org", None, "https://x.org/data-paris", "https://x.org/12"]
    rows = spark.createDataFrame(list(enumerate(urls)), "k int, url string")
    got = {r.k: (r.run, r.hint.land) for r in gazetteer.hinted(rows, "k", F.col("url"), names, home="US").collect()}
    assert got == {0: ("new york", "US"), 1: ("new york", "US"), 2: ("paris", "US")}


def test_hints_carry_no_choices(spark):
    """A name in many lands: what addresses carry from the join on is the thing meant, and no table of addresses is broadcast."""
    names = gazetteer.dictionary(spark.createDataFrame([("rome", f"land{i}", i) for i in range(50)], "name string, land string, population int"))
    urls = spark.createDataFrame([(i, f"https://x.org/jobs/rome-{i}") for i in range(20)], "id int, url string")
    for most, kind in ((0, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")):
        found = gazetteer.hinted(urls, "id", F.col("url"), names, home="land7", broadcast_bytes=most)
        assert {(r.run, r.hint["land"]) for r in found.collect()} == {("rome", "land7")} and found.count() == 20
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert kind in plan
        after = plan[: plan.index(kind)]
        assert "choices" not in after and "hint" in after


# payloads

def test_captures(spark, tmp_path):
    good = json.dumps({"jobs": [{"title": "Dev", "absolute_url": "u1", "location": {"name": "Rome"}}, {"title": "Ops"}, {"absolute_url": "u3"}]})
    rows = [
        ("greenhouse", "a", good), ("greenhouse", "b", "[]"), ("lever", "a", json.dumps([{"text": "QA", "hostedUrl": "u", "categories": {"team": "T"}}])), ("lever", "b", '{"jobs": ['), ("lever", "c", " "),
        ("lever", "d", '{"error": "quota"}'), ("lever", "e", '{"total": 1}'), ("nobody", "a", good), ("smartrecruiters", "s", json.dumps({"content": [{"name": "N", "id": 7, "location": {"city": "Bonn", "country": "de", "remote": True}}]})),
    ]
    folder = str(tmp_path / "boards")
    captures.write(spark.createDataFrame(rows, "platform string, slug string, payload string"), folder)
    every = captures.captured(spark, folder)
    assert every.count() == len(rows) and every.where("raw is null").count() == 0
    got = {(r.platform, r.slug, r.title, r.url, r.location) for r in captures.postings(every).collect()}
    assert got == {("greenhouse", "a", "Dev", "u1", "Rome"), ("lever", "a", "QA", "u", "T"), ("smartrecruiters", "s", "N", "https://jobs.smartrecruiters.com/s/7", "Bonn, de")}
    assert {(r.slug, r.reason) for r in captures.rejected(every).collect()} == {("b", "broken"), ("c", "empty"), ("d", "error"), ("e", "no_list")}
    assert captures.postings(every, wanted=("developer",)).count() == 1
    assert {r.platform for r in captures.captured(spark, folder, ["lever"]).collect()} == {"lever"}
    assert captures.captured(spark, folder, most_bytes=20).where("raw is null").count() == 4


def test_captures_together(spark, tmp_path):
    """A line for each answer: as many rows as with a file for each, in as many files as there are boards, not answers."""
    good = [json.dumps({"jobs": [{"title": f"T{i}", "absolute_url": f"u{i}"}, {"title": "\n"}]}) for i in range(200)]
    rows = [("greenhouse", f"b{i % 2}", x) for i, x in enumerate(good)] + [("lever", "bad", x) for x in ("", None, "x", '{"total":\r\n1}')]
    payloads = spark.createDataFrame(rows, "platform string, slug string, payload string").repartition(4)
    found = {}
    for together in (False, True):
        folder = str(tmp_path / f"boards{together}")
        captures.write(payloads, folder, together=together)
        every = captures.captured(spark, folder, together=together)
        found[together] = (
            sorted(map(tuple, captures.postings(every).select("platform", "slug", "title", "url").collect())), sorted(r.reason for r in captures.rejected(every).collect()), every.count()
        )
    assert found[True] == found[False] and len(found[True][0]) == 200 and found[True][1] == ["broken", "empty", "empty", "no_list"]
    assert every.select("file").distinct().count() == 3
    assert captures.captured(spark, folder, most_bytes=20, together=True).where("raw is null").count() == 200


def test_recipe_postings_of_cut_entities(spark, tmp_path):
    """Titles that end inside an entity, against the SQL."""
    import duckdb

    from hirelake.plans import catalog

    page = '<html lang="fr"><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><article><h1>%s</h1></article></body></html>'
    titles = ["les &amp;&amp", "x &lt", "&quot;y&quot", "a & b &amp;lt; &l", "&copy; &#39;z&#39"]
    spark.createDataFrame([(i, "http://x.example.com/q", page % t) for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["q_recipe_postings"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(f"SELECT page_id, title FROM ({catalog.ORACLE_SQL['q_recipe_postings']})").fetchall()
    assert len(want) == 5 and sorted((r.page_id, r.title) for r in got.collect()) == sorted(want)
