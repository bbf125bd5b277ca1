"""Alert mail by its senders: for each, the layouts that its mails have had, tried in their order.

A sender is known by the domain of its address, or one above it. Layouts of HTML mail are recipes;
layouts of plain text are rules over lines: which link a posting has, and which lines before or
after it are its title, company and place. Overrides put a layout before a sender's own. Where no
layout of the sender finds anything, postings are found by their links alone.

All HTML layouts run in one pass, a mail being parsed once; plain text never leaves the JVM.

Defined results: mail from other senders, without a body, or that only counts postings (unless its
sender's counting mails hold postings too) gives no rows. A posting without a company gets none;
a place that isn't told is null. Links that repeat in a mail count once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.sources import mailbox, recipes

_SALARY = r"\$\d[\d,.]*\s*[Kk]?(?:/\w+)?\s*[-–]+\s*\$\d"
_AGE = r"^(?i:just posted|\d+[hd]?)$"
_LINKS = r"^(?i:apply(?: now)?|view(?: jobs?| all jobs| more| in browser)?|view more opportunities|see more|learn more|click here|unsubscribe|browse jobs|get started)$"
_PLACE = r"(?i:\b(?:remote|hybrid|on-?site)\b)|\b[A-Z][A-Za-z .]+,\s*[A-Z]{2}\b"
_CAPITALS = r"^[A-Z][A-Z\s,/;\-.]{3,150}$"


def _text(selector: str, **more: object) -> dict:
    return {"selector": selector, "attr": "text", **more}


def _href(selector: str, **more: object) -> dict:
    return {"selector": selector, "attr": "href", **more}


def _any_link(*parts: str) -> str:
    return ", ".join(f'a[href*="{p}"]' for p in parts)


_GLASSDOOR = [_href(recipes.SCOPE, regex=r"jobListingId=(\d+)", group=1, lead="https://www.glassdoor.com/job-listing/j?jl="), _href(recipes.SCOPE)]
_ZIP = _any_link("ziprecruiter.com/jobs/", "ziprecruiter.com/apply/", "ziprecruiter.com/job/", "ziprecruiter.com/c/")
_INDEED = _any_link("indeed.com/viewjob", "indeed.com/rc/clk", "indeed.com/job/")


def _beside_link(links: str) -> dict:
    """A link as title, and what stands beside it."""
    return {
        "container_selector": links, "up": 1,
        "fields": {
            "title": [_text("a", skip=_LINKS, match=r"^.{4,99}$"), _text("h1, h2, h3, h4, strong, b", match=r"^.{4,}$"), {"selector": "a", "attr": "aria-label", "match": r"^.{4,}$"}],
            "url": _href("a"), "company": _text("span, div, p", skip=rf"\$\d|{_PLACE}", match=r"^.{2,50}$"), "location": _text("span, div, p", match=_PLACE),
        },
    }


#: Classes and links by which each sender marks its cards. Recipes by sender, in order.
MARKUP: dict[str, list[dict]] = {
    "glassdoor.com": [
        {"container_selector": _any_link("glassdoor.com/partner/jobListing"), "fields": {
            "title": _text("p.gd-6c2846d4dc"), "url": _GLASSDOOR, "company": _text("span.gd-628b46d9ce"), "location": _text("p.gd-28d35bae2f", skip=_SALARY), "pay": _text("p.gd-28d35bae2f", match=_SALARY, every=True)}},
        {"container_selector": _any_link("glassdoor.com/partner/jobListing"), "fields": {
            "title": _text("td.gd-10qqdaw"), "url": _GLASSDOOR, "company": _text("span.gd-forujw", regex=r"^(.*?)[·–—\-\s]*$", group=1), "location": _text("span.gd-56kyx5"), "pay": _text("td.gd-1af37x6", match=_SALARY, every=True)}},
        {"container_selector": _any_link("glassdoor.com/partner/jobListing"), "fields": {
            "title": _text("p", skip=f"{_SALARY}|{_AGE}"), "url": _GLASSDOOR, "company": {"selector": "span", "attr": "own", "skip": r"^\s*\d+\.\d+\s*★?\s*$"},
            "location": _text("p", skip=f"{_SALARY}|{_AGE}", nth=1), "pay": _text("p", match=_SALARY, every=True)}},
    ],
    "ziprecruiter.com": [_beside_link(_ZIP)],
    "indeed.com": [_beside_link(_INDEED)],
    "monster.com": [
        {"container_selector": 'a.hdline-2[href*="click.monster.com"]', "within": "table.width-100", "fields": {
            "title": _text('a.hdline-2[href*="click.monster.com"]'), "url": _href('a.hdline-2[href*="click.monster.com"]'),
            "company": _text("td.hdline-3.left-20 span.hdline-3", skip="^-$"), "location": _text("td.hdline-3.left-20 span.hdline-3", skip="^-$", nth=1, join=", ")}},
    ],
    "trueup.io": [
        {"container_selector": 'a[href*="trueup.io/co/"]', "within": 'div[style*="border:1px solid"]', "fields": {
            "title": _text('a:not([href*="trueup.io/co/"])', match=r"^.{3,200}$"), "url": _href('a:not([href*="trueup.io/co/"])'), "company": _text('a[href*="trueup.io/co/"]', match=r"^.{1,80}$"),
            "location": {"selector": "*", "attr": "own", "match": _CAPITALS}}},
        {"container_selector": "div > table", "up": 1, "fields": {
            "title": _text('a[href*="trueup.io/ls/click"]', match=r"^.{3,150}$"), "url": _href('a[href*="trueup.io/ls/click"]'), "company": _text('a[href*="trueup.io/ls/click"]', match=r"^.{2,80}$", nth=1),
            "location": [_text('div[style*="font-weight:500"], div[style*="font-weight: 500"]', match=r"^.{3,149}$"), _text("div", match=r"^[A-Z\s/]+,[A-Z\s,/]+$")]}},
    ],
    "jobright.ai": [
        {"container_selector": 'a[href*="jobright.ai/jobs/info/"]', "fields": {
            "title": _text("a", skip=f"%|{_LINKS}"), "url": _href(recipes.SCOPE, regex=r"(?i)jobright\.ai/jobs/(?:info/)?([0-9a-f]{16,})", group=1, lead="https://jobright.ai/jobs/info/"),
            "company": _text('p[style*="font-weight:600"]'), "location": _text("p", match=_PLACE, skip=r"·|\$"), "pay": _text("p", match=_SALARY, every=True)}},
    ],
}


@dataclass(frozen=True)
class Lines:
    """A layout of plain text: link of a posting, where its lines stand, and what ends the part that counts.

    before: title, company and place are the first lines of what stands between the link before and
    this one. around: title is the last fit line before the link, company the first one after it.
    head: lines that go first. keep: what of a link stays.
    """

    link: str
    kind: str
    end: str | None = None
    head: str | None = None
    pass_over: str = r"^\(|^http"
    keep: str | None = None


_FOOT = r"(?im)^(?:©|\(c\)|Indeed Tower|Salaries estimated)"
#: Links and marks of the plain mails. Layouts by sender, in order.
PLAIN: dict[str, list[Lines]] = {
    "greenhouse-jobs.com": [Lines(r"https://job-boards\.greenhouse\.io/[^\s()]+/jobs/\d+[^\s()]*", "around", r"(?im)^(?:©|\(c\)|We.ll send your next|Sincerely|Search MyGreenhouse)", pass_over=r"^[()]|^http", keep=r"^\S+/jobs/\d+")],
    "indeed.com": [
        Lines(r"https://engage\.indeed\.com/f/a/\S+", "before", _FOOT, r"(?im)^.*(?:jobs? (?:in|near|for)\b|new jobs?|see matching).*$"),
        Lines(r"https://www\.indeed\.com/rc/clk/dl\?\S+", "before", _FOOT, r"(?im)^.*(?:jobs? (?:in|near|for)\b|new jobs?|see matching).*$"),
    ],
    "match.indeed.com": [
        Lines(r"https://www\.indeed\.com/pagead/clk/dl\?\S+", "before", _FOOT, r"(?s)\A.*?\nJobs are based on[^\n]*"),
        Lines(r"https://cts\.indeed\.com/\S+", "before", _FOOT, r"(?im)^.*[.!][ \t]+[A-Z].*$", r"(?i)^\(|^http|^view job:|^(?:salary|job type|work setting):"),
    ],
    "linkedin.com": [Lines(r"https?://\S*linkedin\.com/(?:comm/)?jobs/view/\S*", "before", None, None, r"(?i)^-{5,}$|^view job:|^http|^\(")],
}
#: Senders whose mails hold postings though they begin like one that only counts them.
COUNTING = ("jobright.ai", "indeed.com", "match.indeed.com")
#: Lines of a card that are neither title, company nor place.
_FURNITURE = r"(?i)^(?:easily apply|just posted|\d+\+? (?:days?|hours?|minutes?) ago.*|apply|responsive employer|hiring multiple.*|urgently hiring|\$.*|\d+[hd]?)$"


def domain_of(sender: Column, known: Sequence[str]) -> Column:
    """The longest known domain that the address is at, or below; null for others."""
    host = F.lower(F.regexp_extract(sender, r"@([A-Za-z0-9.\-]+)", 1))
    found = [F.when((host == d) | F.endswith(host, F.lit(f".{d}")), d) for d in sorted(known, key=lambda d: (-len(d), d))]
    return F.coalesce(*found)


def _fit(line: Column, layout: Lines) -> Column:
    return (line != "") & ~F.regexp_like(line, F.lit(layout.pass_over)) & ~F.regexp_like(line, F.lit(_FURNITURE)) & F.length(line).between(2, 150)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _in_lines(body: Column, layout: Lines) -> Column:
    """Postings of one plain layout: an array of (place, title, url, company, location). Links and lines are worked out once a mail and handed to its cards."""
    link = f"(?i){layout.link}"

    def cut(text: Column) -> Column:
        links = F.transform(F.regexp_extract_all(text, F.lit(link), F.lit(0)), lambda u: F.regexp_replace(u, r"""[.,;)\]>"']+$""", ""))
        links = links if layout.keep is None else F.transform(links, lambda u: F.regexp_extract(u, layout.keep, 0))
        parts = F.transform(F.split(text, link, -1), lambda p: p if layout.head is None else F.regexp_replace(p, layout.head, ""))
        return F.struct(links.alias("links"), F.transform(parts, lambda p: F.filter(_lines(p), lambda x: _fit(x, layout))).alias("fit"))

    def told(mail: Column) -> Column:
        links, fit = mail["links"], mail["fit"]

        def card(url: Column, i: Column) -> Column:
            above = F.get(fit, i)
            if layout.kind == "around":
                below = F.get(fit, i + 1)
                title, company, place = F.try_element_at(above, F.lit(-1)), F.get(below, F.lit(0)), F.lit(None).cast("string")
            else:
                title, second = F.get(above, F.lit(0)), F.get(above, F.lit(1))
                # a company's line may end with the place
                company = F.regexp_replace(second, r"\s+[-–·]\s+.*$", "")
                place = F.coalesce(F.nullif(F.regexp_extract(second, r"\s+[-–·]\s+(.*)$", 1), F.lit("")), F.get(above, F.lit(2)))
            return F.struct(i.alias("place"), title.alias("title"), url.alias("url"), company.alias("company"), place.alias("location"))

        first = F.filter(F.transform(links, card), lambda c: (F.array_position(links, c["url"]) == c["place"] + 1) & c["title"].isNotNull())
        return F.transform(first, lambda c, i: c.withField("place", i))

    text = body if layout.end is None else F.regexp_replace(body, rf"(?s){layout.end}.*$", "")
    return F.get(F.transform(F.transform(F.array(text), cut), told), F.lit(0))


def postings(mail: DataFrame, sender: str = "sender", body: str = "body", overrides: Mapping[str, dict] | None = None, fallback: bool = True) -> DataFrame:
    """mail's columns with title, company, location, url and place of each posting, and `layout`, how it was found: markup, lines or links.

    overrides: recipes by sender, each tried before the sender's own.
    """
    over = dict(overrides or {})
    made = {d: [*([over[d]] if d in over else []), *MARKUP.get(d, [])] for d in {*MARKUP, *over}}
    checked = {d: [recipes.checked("email", {"source": d, **r}) for r in rs] for d, rs in made.items()}
    rounds = [{d: rs[k] for d, rs in checked.items() if len(rs) > k} for k in range(max(map(len, checked.values())))]
    text = F.coalesce(F.col(body), F.lit(""))
    domain = domain_of(F.col(sender), [*checked, *PLAIN])
    rows = mail.withColumn("_domain", domain).where(F.col("_domain").isNotNull() & (F.trim(text) != ""))
    rows = rows.where(F.col("_domain").isin(*COUNTING) | ~mailbox.is_meta(F.col(body))).withColumn("_mail", F.monotonically_increasing_id())
    markup = F.regexp_like(text, F.lit(r"(?i)<(?:html|body|table|div|a)\b"))
    plain = F.array().cast("array<struct<place:int,title:string,url:string,company:string,location:string>>")
    for d, layouts in PLAIN.items():
        found = mailbox.first_found(*[_in_lines(text, x) for x in layouts])
        plain = F.when((F.col("_domain") == d) & ~markup, found).otherwise(plain)
    # generated with a null for none, so that no filter looks through the lines a second time
    lined = rows.where(~markup).select("*", F.explode_outer(plain).alias("_p"))
    kept = ["title", "company", "location", "url", "place"]

    def out(df: DataFrame, found: str, layout: str) -> DataFrame:
        return df.select(*mail.columns, *(F.col(f"{found}.{c}").alias(c) for c in kept), F.lit(layout).alias("layout"))

    every = out(lined.where(F.col("_p").isNotNull()), "_p", "lines")
    rich = rows.where(markup)
    root = F.when(F.col("_domain") == "match.indeed.com", "indeed.com").otherwise(F.col("_domain"))
    by_markup = recipes.first_found(rich, rounds, root, F.col(body), F.lit(None).cast("string"), "_p")
    every = every.unionByName(out(by_markup, "_p", "markup"))
    if fallback:
        left = lined.where(F.col("_p").isNull()).drop("_p")
        by_links = mailbox.linked_postings(left, body).withColumn("location", F.lit(None).cast("string"))
        every = every.unionByName(by_links.select(*mail.columns, *kept, F.lit("links").alias("layout")))
    return every
