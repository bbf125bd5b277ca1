"""URL forms and predicates, as column expressions that never raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Tracking parameters that carry no identity, beside utm_* and mc_*.
TRACKING = ("gclid", "fbclid", "msclkid", "ref", "referer", "referrer", "trk", "source")
#: Path beginnings of navigation pages.
NAV_PATHS = ("/about", "/blog", "/contact", "/privacy", "/terms", "/login", "/signup", "/search", "/category", "/tag")
SLUG_ENDING = r"[-_]?(?:[0-9a-f]{8,}|\d+)$"


def host(url: Column) -> Column:
    """Small letters, without user and port; null where there is none."""
    out = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(out, F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme and host in small letters, tracking parameters dropped, the rest in order; what isn't a URL is unchanged."""
    begin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(pairs, lambda p: ~(name(p).isin(*TRACKING) | F.startswith(name(p), F.lit("utm_")) | F.startswith(name(p), F.lit("mc_")))))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(begin == "", url).otherwise(F.concat(F.lower(begin), path(url), rest, fragment))


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def under(url: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = F.coalesce(host(url), F.lit(""))
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return out


def is_navigation(url: Column) -> Column:
    p = F.lower(path(url))
    out = F.lit(False)
    for beginning in NAV_PATHS:
        out = out | (p == beginning) | F.startswith(p, F.lit(beginning + "/"))
    return out


def title_from_slug(url: Column) -> Column:
    """The last path part as a title: marks as spaces, a number at the end dropped, words capitalised."""
    last = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(last, SLUG_ENDING, ""), r"[-_+]+", " ")))


#: Boards of applicant systems: platform, pattern whose first group is the company's slug, and how much it tells.
BOARDS = (
    ("greenhouse", r"^https?://boards-api\.greenhouse\.io/v1/boards/([\w-]+)", 4),
    ("lever", r"^https?://api\.lever\.co/v0/postings/([\w.-]+)", 4),
    ("ashby", r"^https?://api\.ashbyhq\.com/posting-api/job-board/([^/?#]+)", 4),
    ("smartrecruiters", r"^https?://api\.smartrecruiters\.com/v1/companies/([\w-]+)", 4),
    ("greenhouse", r"^https?://(?:job-)?boards(?:\.eu)?\.greenhouse\.io/(?:embed/job_(?:board|app)\?for=)?([\w-]+)", 3),
    ("lever", r"^https?://jobs(?:\.eu)?\.lever\.co/([\w.-]+)", 3),
    ("ashby", r"^https?://jobs\.ashbyhq\.com/([^/?#]+)", 3),
    ("smartrecruiters", r"^https?://(?:jobs|careers)\.smartrecruiters\.com/([\w-]+)", 3),
    ("workable", r"^https?://apply\.workable\.com/(?!api/)([\w-]+)", 3),
    ("workday", r"^https?://([\w-]+)\.(?:wd\d+\.)?myworkdayjobs\.com", 2),
    ("recruitee", r"^https?://([\w-]+)\.recruitee\.com", 2),
    ("breezy", r"^https?://([\w-]+)\.breezy\.hr", 2),
    ("bamboohr", r"^https?://([\w-]+)\.bamboohr\.com", 2),
    ("teamtailor", r"^https?://([\w-]+)\.teamtailor\.com", 2),
    ("personio", r"^https?://([\w-]+)\.jobs\.personio\.(?:de|com)", 2),
    ("jazzhr", r"^https?://([\w-]+)\.applytojob\.com", 2),
    ("pinpoint", r"^https?://([\w-]+)\.pinpointhq\.com", 2),
    ("rippling", r"^https?://ats\.rippling\.com/(?:[a-z]{2}-[a-z]{2}/)?([\w-]+)", 3),
    ("paylocity", r"^https?://recruiting\.paylocity\.com/recruiting/jobs/all/([0-9a-f-]{36})", 3),
    ("successfactors", r"^https?://career\d*\.successfactors\.(?:com|eu)/.*[?&]company=([\w-]+)", 2),
    ("oracle_cloud", r"^https?://([\w-]+)\.fa\.(?:[\w-]+\.)?oraclecloud\.com", 2),
    ("ultipro", r"^https?://recruiting\d*\.ultipro\.(?:com|ca)/([\w-]+)", 2),
    ("eightfold", r"^https?://([\w-]+)\.eightfold\.ai", 2),
    ("adp", r"^https?://workforcenow\.adp\.com/.*[?&]cid=([0-9a-f-]{36})", 2),
    ("icims", r"^https?://(?:careers-|jobs-)?([\w-]+)\.icims\.com", 1),
)
#: Patterns of a posting's id in the URL, by platform, in order.
POSTING_IDS = {
    "greenhouse": (r"/jobs/(\d+)", r"[?&]gh_jid=(\d+)", r"[?&]token=(\d+)"),
    "lever": (r"lever\.co/[^/]+/([0-9a-f-]{36})",),
    "ashby": (r"ashbyhq\.com/[^/]+/([0-9a-f-]{36})",),
    "smartrecruiters": (r"smartrecruiters\.com/[^/]+/(\d+)",),
    "workday": (r"_([A-Za-z]*-?\d[\w-]*)/?(?:[?#].*)?$",),
    "workable": (r"workable\.com/[^/]+/j/([0-9A-F]{10})",),
    "breezy": (r"breezy\.hr/p/([0-9a-f]{12})",),
    "bamboohr": (r"bamboohr\.com/careers/(\d+)", r"bamboohr\.com/jobs/view\.php\?id=(\d+)"),
    "teamtailor": (r"/jobs/(\d+)",),
    "personio": (r"/job/(\d+)",),
    "pinpoint": (r"/postings/([0-9a-f-]{36})",),
    "rippling": (r"/jobs/([0-9a-f-]{36})",),
    "paylocity": (r"/details/(\d+)",),
    "successfactors": (r"[?&]career_job_req_id=(\d+)", r"/job/[^/]+/(\d+)"),
    "oracle_cloud": (r"/job/(\d+)",),
    "ultipro": (r"[?&]opportunityId=([0-9a-f-]{36})",),
    "eightfold": (r"/careers/job/(\d+)", r"[?&]pid=(\d+)"),
    "adp": (r"[?&]jobId=(\d+)",),
    "icims": (r"/jobs/(\d+)",),
}
#: Parts of paths of postings.
JOB_PATHS = ("/jobs/", "/careers/", "/positions/", "/openings/")
_LEGAL = r"(?i)[,\s]+(?:inc\.?|llc\.?|corp\.?|corporation\.?|ltd\.?|limited\.?|co\.?|company\.?)$"


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))


def board(url: Column) -> Column:
    """struct(platform, slug, weight) of the board a URL is on, of the most telling pattern that fits; null for none."""
    every = [F.when(_group(url, p).isNotNull(), F.struct(F.lit(w).alias("weight"), F.lit(-k).alias("turn"), F.lit(n).alias("platform"), F.lower(_group(url, p)).alias("slug"))) for k, (n, p, w) in enumerate(BOARDS)]
    best = F.array_max(F.array_compact(F.array(*every)))
    return F.when(best.isNotNull(), F.struct(best["platform"].alias("platform"), best["slug"].alias("slug"), best["weight"].alias("weight")))


def first_board(urls: Column) -> Column:
    """The board of the first URL that is on one."""
    return F.get(F.filter(F.transform(urls, board), lambda b: b.isNotNull()), F.lit(0))


def posting_id(url: Column, platform: Column) -> Column:
    """The posting's id in its URL; null for other platforms and URLs without one."""
    out = F.lit(None).cast("string")
    for name, patterns in POSTING_IDS.items():
        out = F.when(platform == name, F.coalesce(*(_group(url, p) for p in patterns))).otherwise(out)
    return out


def slug_candidates(company: Column) -> Column:
    """A company's likely slugs: its words with hyphens, then run together, without a legal form."""
    name = F.trim(F.regexp_replace(F.lower(company), _LEGAL, ""))
    hyphens = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.filter(F.array_distinct(F.array(hyphens, F.regexp_replace(name, "[^a-z0-9]+", ""))), lambda x: x != "")


def slug_strength(name: Column, slug: Column) -> Column:
    """3: one holds the other; 2: a word of one is in the other; 0: neither."""
    norm = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    words = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    a, b = F.coalesce(norm(name), F.lit("")), F.coalesce(norm(slug), F.lit(""))
    some = F.exists(words(name), lambda w: F.contains(b, w)) | F.exists(words(slug), lambda w: F.contains(a, w))
    return F.when((a == "") | (b == ""), 0).when(F.contains(a, b) | F.contains(b, a), 3).when(some, 2).otherwise(0)


def is_posting(url: Column) -> Column:
    p = F.lower(path(url))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in JOB_PATHS]), F.lit(False))


def first_hosted(urls: Column) -> Column:
    """The first URL that is on an applicant system's board."""
    return F.get(F.filter(urls, lambda u: board(u).isNotNull()), F.lit(0))


def direct_link(urls: Column, from_board: Column, from_careers: Column) -> Column:
    """struct(url, source): a hosted source URL, else the board's match, else the careers page's; null for none."""
    option = lambda u, n: F.when(F.coalesce(F.trim(u), F.lit("")) != "", F.struct(u.alias("url"), F.lit(n).alias("source")))
    return F.coalesce(option(first_hosted(urls), "source"), option(from_board, "ats"), option(from_careers, "careers"))


def apply_link(strict: Column, loose: Column, urls: Column, expired: Column, use_loose: bool = False) -> Column:
    """The link to apply by: strict, then loose if that is wanted, then the first source URL that isn't blank; an expired posting has source URLs only."""
    some = lambda u: F.when(~F.coalesce(expired, F.lit(False)), F.nullif(F.trim(u), F.lit("")))
    source = F.get(F.filter(urls, lambda u: F.trim(u) != ""), F.lit(0))
    return F.coalesce(some(strict), *([some(loose)] if use_loose else []), source)


def domain_rank(url: Column, ranked: tuple[str, ...]) -> Column:
    """The place of the URL's domain among the ranked ones, or their number."""
    out = F.lit(len(ranked))
    for k in reversed(range(len(ranked))):
        out = F.when(under(url, (ranked[k],)), k).otherwise(out)
    return out


def ranked_results(urls: Column, blocked: tuple[str, ...], ranked: tuple[str, ...]) -> Column:
    """URLs each once, without those of blocked domains, by rank of domain and then in order."""
    once = F.filter(F.array_distinct(urls), lambda u: ~under(u, blocked))
    marked = F.transform(once, lambda u, i: F.struct(domain_rank(u, ranked).alias("r"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(marked), lambda x: x["u"])


def requisition_in(url: Column) -> Column:
    """The number of a posting that stands in an address: two capitals and six digits or more, else 15 digits or more, else jobId; null for none."""
    found = [F.regexp_extract(url, p, g) for p, g in ((r"[A-Z]{2}\d{6,}[A-Z0-9\-]*", 0), (r"\b\d{15,}\b", 0), (r"[?&]jobId=([A-Za-z0-9\-]+)", 1))]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))
