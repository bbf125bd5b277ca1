"""Bodies of alert mail: summaries that hold no postings, and postings found by their links alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.content import is_candidate_line

#: Beginnings of mail that only counts postings (read in the first 200 characters).
META = (r"(?im)^\d+\+?\s+new\s+jobs?\s+match", r"(?i)job alert digest|weekly digest", r"(?i)you have \d+ new jobs?", r"(?im)^\d+ jobs? found")
#: Links of postings, and words that stand for nothing.
JOB_LINK = (
    r"https?://\S*linkedin\.com/jobs/view/\S*", r"https?://\S*indeed\.com/\S*[?&]jk=\S*", r"https?://job-boards\.greenhouse\.io/\S+", r"https?://jobs\.lever\.co/\S+",
    r"https?://jobs\.ashbyhq\.com/\S+", r"https?://\S*ziprecruiter\.com/(?:jobs|apply|job|c/[^/\s]+/Job)/\S*", r"https?://\S*glassdoor\.com/partner/jobListing\S*", r"https?://\S*myworkdayjobs\.com/\S+",
)
PLACEHOLDERS = ("title", "body", "unknown", "name", "company", "location", "n/a", "none")
WINDOW = 10


def is_meta(body: Column) -> Column:
    """Whether a mail only counts or sums up postings; a null body doesn't."""
    head, out = F.substr(body, F.lit(1), F.lit(200)), F.lit(False)
    for pattern in META:
        out = out | F.regexp_like(head, F.lit(pattern))
    return F.coalesce(out, F.lit(False))


def _speaks(line: Column) -> Column:
    """Whether a line may be a title or a company."""
    return is_candidate_line(line) & ~F.lower(line).isin(*PLACEHOLDERS)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def linked_postings(mail: DataFrame, body: str = "body") -> DataFrame:
    """Postings by their links: title is the nearest line before that may be one, company the nearest after, of ten lines each.

    A link counts where it comes first in the mail; one without title or company makes no posting.
    The columns of mail stay; title, company and url are added, place is the link's number in its mail.
    """
    pattern = "(?i)" + "|".join(JOB_LINK)
    raw = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))
    cut = mail.withColumn("_raw", raw).where(F.size("_raw") > 0).withColumn("_between", F.split(F.col(body), pattern, -1))
    clean = cut.withColumn("_urls", F.transform("_raw", lambda u: F.regexp_replace(u, r"""[.,;)\]>"']+$""", "")))
    rows = clean.select("*", F.posexplode("_urls").alias("place", "url")).where(F.array_position("_urls", F.col("url")) == F.col("place") + 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    begin = total(F.slice("_between", F.lit(1), F.col("place") + 1)) + total(F.slice("_raw", F.lit(1), F.col("place")))
    before = _lines(F.left(F.col(body), begin))
    after = _lines(F.substr(F.col(body), begin + F.length(F.get("_raw", F.col("place"))) + 1))
    title = F.get(F.filter(F.slice(F.reverse(before), 1, WINDOW), _speaks), F.lit(0))
    company = F.get(F.filter(F.slice(after, 1, WINDOW), lambda x: ~F.startswith(x, F.lit(")")) & ~F.startswith(x, F.lit("(")) & _speaks(x)), F.lit(0))
    # an array of one or none, so that the lines are looked through once and not again by the filter
    told = F.filter(F.array(F.struct(title.alias("title"), company.alias("company"))), lambda x: x["title"].isNotNull() & x["company"].isNotNull())
    return rows.select("*", F.inline(told)).drop("_raw", "_between", "_urls")


def first_found(*candidates: Column) -> Column:
    """The first array that holds anything: strategies in their order, each worked out once and only if those before found nothing. None: the last one."""

    def else_(first: Column, rest: Column) -> Column:
        return F.get(F.transform(F.array(first), lambda found: F.when(F.size(found) > 0, found).otherwise(rest)), F.lit(0))

    return reduce(lambda rest, c: else_(c, rest), reversed(candidates[:-1]), candidates[-1])
