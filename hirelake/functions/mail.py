"""Signals of mail about postings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hirelake.functions.content import mail_kind
from hirelake.functions.places import PLATFORMS

#: Words of company names that tell nothing.
COMPANY_STOP = ("inc", "incorporated", "corp", "corporation", "limited", "company", "group", "holdings", "technologies", "technology", "solutions", "services", "systems", "health", "labs", "tech", "software", "global")
#: Words of titles that tell nothing.
TITLE_STOP = ("senior", "staff", "lead", "data", "the", "and", "for", "with")


def email_class(subject: str, body: str) -> Column:
    """rejection before interview before confirmation; null for other mail."""
    return mail_kind(F.col(subject), F.col(body))


def domain_of(sender: Column) -> Column:
    """The domain of "a@b.c" or "Name <a@b.c>", in small letters; null without one."""
    return F.nullif(F.lower(F.regexp_extract(sender, r"@([\w.-]+)", 1)), F.lit(""))


def telling(company: Column) -> Column:
    """The words of a company's name with four letters or more that aren't in COMPANY_STOP."""
    words = F.transform(F.split(F.lower(F.trim(company)), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()&]+|[.,;:()&]+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMPANY_STOP))


def _word_in(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"\b"), F.lit(r"\Q"), word, F.lit(r"\E"), F.lit(r"\b")))


def names_company(company: Column, subject: Column, sender: Column) -> Column:
    """The whole name, or all its telling words, as words of the subject or sender."""
    surface, own = F.lower(F.concat_ws(" ", subject, sender)), telling(company)
    name = F.lower(F.trim(company))
    found = ((name != "") & _word_in(surface, name)) | ((F.size(own) > 0) & F.forall(own, lambda w: _word_in(surface, w)))
    return F.coalesce(found, F.lit(False))


def names_title(title: Column, text: Column) -> Column:
    """Two of the title's telling words in the text, or the only one."""
    words = F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    own = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*TITLE_STOP))
    hits = F.size(F.filter(own, lambda w: F.contains(text, w)))
    return F.coalesce(hits >= F.least(F.size(own), F.lit(2)), F.lit(False)) & (F.coalesce(F.size(own), F.lit(0)) > 0)


def within_days(sent: Column, seen: Column, days: int) -> Column:
    """Whole days between, rounded down, are at most so many either way."""
    between = F.floor((F.unix_micros(sent.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 86_400_000_000)
    return F.coalesce(F.abs(between) <= days, F.lit(False))


def from_applicant_system(sender: Column) -> Column:
    """Whether the sender's domain is an applicant system's, or below it."""
    d = F.coalesce(domain_of(sender), F.lit(""))
    return reduce(lambda a, b: a | b, [(d == x) | F.endswith(d, F.lit("." + x)) for x, _ in PLATFORMS])


def from_company(sender: Column, company: Column) -> Column:
    """Whether the sender's domain holds every telling word of the company."""
    d, own = domain_of(sender), telling(company)
    return F.coalesce((F.size(own) > 0) & F.forall(own, lambda w: F.contains(d, w)), F.lit(False))


def snippet(body: Column, keywords: tuple[str, ...], most: int = 200) -> Column:
    """The first sentence with the first keyword that the body holds, up to so many characters; null without any."""
    sentences = F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))

    def with_word(word: str) -> Column:
        return F.get(F.filter(sentences, lambda s: F.contains(F.lower(s), F.lit(word))), F.lit(0))

    hits = [with_word(k) for k in keywords]
    return F.substring(F.coalesce(*hits), 1, most)


def company_of_sender(sender: Column) -> Column:
    """The display name without words like "Careers" or "via …"; else the domain's name, unless an applicant system's; else null."""
    name = F.trim(F.regexp_replace(F.regexp_extract(sender, r'^\s*"?([^"<@]+?)"?\s*<', 1), r"(?i)\s*(?:\bvia\b.*|\b(?:careers?|jobs?|recruiting|recruitment|talent(?: acquisition)?|hiring(?: team)?|team|hr|no-?reply)\b)\s*", " "))
    own = F.when(~from_applicant_system(sender), F.initcap(F.regexp_extract(F.coalesce(domain_of(sender), F.lit("")), r"([^.]+)\.[^.]+$", 1)))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(own, F.lit("")))
