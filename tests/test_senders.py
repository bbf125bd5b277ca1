"""One mail of each layout a sender has had, the order of layouts, overrides and the way back to links alone."""

import pytest
from pyspark.sql import functions as F

from hirelake.sources import mailbox, recipes, senders

GLASSDOOR_OLD = """<html><body><a href="https://www.glassdoor.com/partner/jobListing.htm?pos=1&amp;jobListingId=1001"><span class="gd-628b46d9ce">Acme</span>
<p class="gd-6c2846d4dc">Data Engineer</p><p class="gd-28d35bae2f">Austin, TX</p><p class="gd-28d35bae2f">$120K - $150K (Employer est.)</p></a></body></html>"""
GLASSDOOR_PLAIN = """<html><body><a href="https://www.glassdoor.com/partner/jobListing.htm?jobListingId=1002"><span><span>Beta Ltd</span><span>3.6 ★</span></span>
<p>5d</p><p>$90K - $110K</p><p>QA Lead</p><p>Remote</p></a></body></html>"""
GLASSDOOR_TABLE = """<html><body><a href="https://www.glassdoor.com/partner/jobListing.htm?jobListingId=1003"><img src="logo"></a>
<a href="https://www.glassdoor.com/partner/jobListing.htm?jobListingId=1003"><table><tr><td class="gd-10qqdaw">Site Manager</td></tr></table>
<span class="gd-forujw">Gamma · </span><span class="gd-56kyx5">Boise, ID</span></a></body></html>"""
ZIP = """<html><body><div><a href="https://www.ziprecruiter.com/jobs/acme/dev-12345678?tk=1">Senior Developer</a><span>Acme Corp</span><p>Denver, CO</p></div>
<div><a href="https://www.ziprecruiter.com/jobs/x/y-1" aria-label="Nurse on call">Apply</a><span>$30 an hour</span><span>Clinic</span></div></body></html>"""
MONSTER = """<html><body><table class="outer width-100"><tr><td><table class="width-100"><tr><td><a class="hdline-2" href="https://click.monster.com/1">Welder  II</a></td></tr>
<tr><td class="hdline-3 left-20"><span class="hdline-3">Steel Inc</span><span class="hdline-3"> - </span><span class="hdline-3">Akron</span><span class="hdline-3"> - </span><span class="hdline-3">OH</span></td></tr></table>
<table class="width-100"><tr><td><a class="hdline-2" href="https://click.monster.com/2">Cook</a></td></tr><tr><td class="hdline-3 left-20"><span class="hdline-3">Diner</span></td></tr></table></td></tr></table></body></html>"""
TRUEUP = """<html><body><div style="padding:1px;border:1px solid #ccc"><a href="https://boards.example.org/p/7">Staff Engineer</a><a href="https://www.trueup.io/co/acme">Acme</a><div>MOUNTAIN VIEW, CA, USA</div></div></body></html>"""
TRUEUP_OLD = """<html><body><div><table><tr><td><a href="http://url12.trueup.io/ls/click?a=1">Designer</a><a href="http://url12.trueup.io/ls/click?a=2">Beta</a>
<div style="color:red;font-weight:500">Berlin, Germany</div></td></tr></table></div></body></html>"""
JOBRIGHT = """<html><body><a href="https://jobright.ai/jobs/info/65f0c0ffee65f0c0ffee1234?x=1"><table><tr><td><p style="margin:0;font-weight:600">Acme</p><p style="font-weight:400">Health · Series B</p><span>93 %</span>
<a href="https://jobright.ai/jobs/info/65f0c0ffee65f0c0ffee1234?x=1">ML Engineer</a><p>$138K/yr - $198K/yr</p><p>Boston, MA</p><a href="https://jobright.ai/jobs/info/65f0c0ffee65f0c0ffee1234?x=1">APPLY NOW</a></td></tr></table></a>
<a href="https://jobright.ai/jobs/recommend">View More Opportunities</a></body></html>"""
INDEED_HTML = """<html><body><td><a href="https://www.indeed.com/viewjob?jk=abc">Office Clerk</a><div>Town Hall</div><div>Reno, NV</div></td></body></html>"""
GREENHOUSE = """Here's your weekly update

Product Manager
( https://job-boards.greenhouse.io/acme/jobs/4567?gh_src=1 )

Acme
Product

Analyst
( https://job-boards.greenhouse.io/beta/jobs/4568 )

Beta Inc.

Sincerely
Someone ( https://job-boards.greenhouse.io/late/jobs/1 )"""
INDEED = """3 new jobs for analyst in Austin
See matching results

Data Analyst
Acme - Austin, TX
$70,000 - $80,000 a year
Easily apply
Just posted
https://engage.indeed.com/f/a/one

BI Developer
Beta
Remote
2 days ago
https://engage.indeed.com/f/a/two

© 2026 Indeed"""
MATCH = """Some words for you. Read them.
Jobs are based on your preferences, profile, and activity on Indeed
Night Nurse
Clinic - Salem, OR
https://www.indeed.com/pagead/clk/dl?x=1
"""
MATCH_ONE = """Hi there. We found something. It would suit you.
Baker
Bread Co
Lyon
Salary: $20 an hour
View job: https://cts.indeed.com/v3/abc
"""
LINKEDIN = "Site Engineer\nAcme\nOslo, Norway\nView job: https://www.linkedin.com/comm/jobs/view/12?x=1\n\n---------------\n\nPlanner\nBeta\nBergen\nView job: https://www.linkedin.com/comm/jobs/view/13"

MAILS = [
    ("noreply@glassdoor.com", GLASSDOOR_OLD, [("Data Engineer", "Acme", "Austin, TX", "https://www.glassdoor.com/job-listing/j?jl=1001")]),
    ("noreply@glassdoor.com", GLASSDOOR_PLAIN, [("QA Lead", "Beta Ltd", "Remote", "https://www.glassdoor.com/job-listing/j?jl=1002")]),
    ("noreply@glassdoor.com", GLASSDOOR_TABLE, [("Site Manager", "Gamma", "Boise, ID", "https://www.glassdoor.com/job-listing/j?jl=1003")]),
    ("no-reply@ziprecruiter.com", ZIP, [("Senior Developer", "Acme Corp", "Denver, CO", "https://www.ziprecruiter.com/jobs/acme/dev-12345678?tk=1"), ("Nurse on call", "Clinic", None, "https://www.ziprecruiter.com/jobs/x/y-1")]),
    ("monster@notifications.monster.com", MONSTER, [("Welder  II", "Steel Inc", "Akron, OH", "https://click.monster.com/1"), ("Cook", "Diner", None, "https://click.monster.com/2")]),
    ("hello@trueup.io", TRUEUP, [("Staff Engineer", "Acme", "MOUNTAIN VIEW, CA, USA", "https://boards.example.org/p/7")]),
    ("hello@trueup.io", TRUEUP_OLD, [("Designer", "Beta", "Berlin, Germany", "http://url12.trueup.io/ls/click?a=1")]),
    ("noreply@jobright.ai", JOBRIGHT, [("ML Engineer", "Acme", "Boston, MA", "https://jobright.ai/jobs/info/65f0c0ffee65f0c0ffee1234")]),
    ("alert@indeed.com", INDEED_HTML, [("Office Clerk", "Town Hall", "Reno, NV", "https://www.indeed.com/viewjob?jk=abc")]),
    ("no-reply@us.greenhouse-jobs.com", GREENHOUSE, [("Product Manager", "Acme", None, "https://job-boards.greenhouse.io/acme/jobs/4567"), ("Analyst", "Beta Inc.", None, "https://job-boards.greenhouse.io/beta/jobs/4568")]),
    ("Indeed <alert@indeed.com>", INDEED, [("Data Analyst", "Acme", "Austin, TX", "https://engage.indeed.com/f/a/one"), ("BI Developer", "Beta", "Remote", "https://engage.indeed.com/f/a/two")]),
    ("donotreply@match.indeed.com", MATCH, [("Night Nurse", "Clinic", "Salem, OR", "https://www.indeed.com/pagead/clk/dl?x=1")]),
    ("donotreply@match.indeed.com", MATCH_ONE, [("Baker", "Bread Co", "Lyon", "https://cts.indeed.com/v3/abc")]),
    ("jobalerts-noreply@linkedin.com", LINKEDIN, [("Site Engineer", "Acme", "Oslo, Norway", "https://www.linkedin.com/comm/jobs/view/12?x=1"), ("Planner", "Beta", "Bergen", "https://www.linkedin.com/comm/jobs/view/13")]),
    ("someone@else.org", LINKEDIN, []), ("alert@notindeed.com", INDEED, []), ("alert@indeed.com", None, []), ("hello@trueup.io", "  ", []), (None, INDEED, []),
    ("noreply@glassdoor.com", "12 new jobs match your search\nhttps://www.glassdoor.com/partner/jobListing.htm?jobListingId=1", []),
]


@pytest.fixture(scope="module")
def found(spark):
    mail = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(MAILS)], "place_no int, sender string, body string")
    got = {}
    for r in senders.postings(mail).collect():
        got.setdefault(r.place_no, []).append((r.place, (" ".join(r.title.split()), r.company, r.location, r.url)))
    return {k: [x for _, x in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("i", range(len(MAILS)))
def test_layouts(found, i):
    assert found.get(i, []) == [(" ".join(t.split()), *rest) for t, *rest in MAILS[i][2]]


def test_overrides_and_links(spark):
    plain = "Dev\nhttps://jobs.lever.co/acme/1\nAcme\n"
    mail = spark.createDataFrame([(1, "a@trueup.io", TRUEUP), (2, "a@trueup.io", TRUEUP_OLD), (3, "x@linkedin.com", plain), (4, "a@new.org", "<div class=job><b>New</b><a href=u>x</a></div>")], "n int, sender string, body string")
    own = {"trueup.io": {"container_selector": 'div[style^="padding"]', "fields": {"title": senders._text("div"), "url": senders._href("a")}}, "new.org": {"container_selector": ".job", "fields": {"title": senders._text("b"), "url": senders._href("a")}}}
    got = {(r.n, r.title, r.company, r.layout) for r in senders.postings(mail, overrides=own).collect()}
    assert got == {(1, "MOUNTAIN VIEW, CA, USA", None, "markup"), (2, "Designer", "Beta", "markup"), (3, "Dev", "Acme", "links"), (4, "New", None, "markup")}
    assert {r.n for r in senders.postings(mail, fallback=False).collect()} == {1, 2}
    with pytest.raises(ValueError):
        senders.postings(mail, overrides={"trueup.io": {"container_selector": "div"}})
    assert senders.postings(mail.limit(0)).count() == 0


def test_rules_of_a_recipe():
    page = recipes.Page("<div class=c><p>skip 1</p><p>two</p><p>three</p><p>four</p><span>a<b>c</b></span></div>")

    def one(**rule):
        made = recipes.checked("email", {"source": "s", "container_selector": ".c", "fields": {"title": {"attr": "text", **rule}, "url": {"selector": "p", "attr": "text"}}})
        return (recipes.Extractor(made)(page, None) or [{"title": None}])[0]["title"]

    assert one(selector="p", skip="skip") == "two" and one(selector="p", match="^t", nth=1) == "three" and one(selector="p", nth=9) is None
    assert one(selector="p", skip="^s", nth=1, join=", ") == "three, four" and one(selector="span", attr="own") == "a" and one(selector="span") == "ac"
    assert one(selector=":scope", attr="class", lead="x-") == "x-c"
    made = recipes.checked("email", {"source": "s", "container_selector": "b", "up": 2, "fields": {"title": {"selector": "p", "attr": "text"}, "url": {"selector": "p", "attr": "text"}}})
    assert recipes.Extractor(made)(page, None)[0]["title"] == "skip 1" and recipes.checked("email", recipes.as_mapping(made)) == made


def test_lines_are_worked_out_once_a_mail(spark):
    """Neither a card nor a layout that comes later in the order looks through the whole mail again."""
    layout = senders.PLAIN["indeed.com"][0]

    def steps(found):
        plan = spark.createDataFrame([(INDEED,)], "body string").select(found.alias("found"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("regexp_extract_all("), plan.count(r"jobs? (?:in|near|for)")

    assert steps(senders._in_lines(F.col("body"), layout)) == (1, 1)
    assert steps(mailbox.first_found(*[senders._in_lines(F.col("body"), x) for x in senders.PLAIN["indeed.com"]])) == (2, 2)
