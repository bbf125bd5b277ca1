"""Normal forms of company names and titles, and the keys made of them, as column expressions.

Null in, null out. White space and case follow Java's rules for the ASCII range.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Legal and generic endings of company names.
COMPANY_ENDINGS = (
    "inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company",
    "technologies", "technology", "tech", "group", "holdings?", "services?", "solutions?",
)
#: Abbreviations in titles, in order, for the key.
TITLE_SHORT_FORMS = (
    (r"\bsr\.(?=\s|$)", "senior"), (r"\bjr\.(?=\s|$)", "junior"), (r"\bmgr\.(?=\s|$)", "manager"),
    (r"\beng\.(?=\s|$)", "engineering"), (r"\bdir\.(?=\s|$)", "director"), (r"\bvp\.(?=\s|$)", "vice president"),
    (r"\bswe\.(?=\s|$)", "software engineer"), (r"\bpm\.(?=\s|$)", "product manager"),
    (r"\bsr\b(?!\.)", "senior"), (r"\bjr\b(?!\.)", "junior"), (r"\bmgr\b(?!\.)", "manager"),
)
#: Abbreviations in titles, in order, for matching against wanted titles.
MATCH_SHORT_FORMS = (
    (r"Sr\.?", "senior"), (r"Jr\.?", "junior"), (r"Mgr\.?", "manager"), (r"Mgmt\.?", "management"),
    (r"Eng\.?", "engineer"), (r"Engr\.?", "engineer"), (r"Dev\.?", "developer"), (r"Arch\.?", "architect"),
    ("Ops", "operations"), ("Admin", "administrator"), (r"Dir\.?", "director"), ("VP", "vice president"),
    ("DS", "data scientist"), ("DA", "data analyst"), ("DE", "data engineer"), ("PM", "product manager"),
    ("TPM", "technical program manager"), ("EM", "engineering manager"), ("MLE", "machine learning engineer"),
    ("ML", "machine learning"), ("AI", "artificial intelligence"), ("SRE", "site reliability engineer"),
    ("SWE", "software engineer"), ("SE", "software engineer"), ("IC", "individual contributor"),
    ("QA", "quality assurance"), ("UX", "user experience"), ("UI", "user interface"),
)
#: Words that say nothing about what a title is.
TITLE_STOP_WORDS = (
    "senior", "sr", "junior", "jr", "staff", "principal", "lead", "head", "associate", "assistant", "manager", "director",
    "vp", "vice", "president", "chief", "intern", "internship", "co", "op", "coop", "the", "and", "or", "of", "for", "in",
    "at", "to", "a", "an", "remote", "hybrid", "onsite", "fulltime", "part", "time", "contract", "i", "ii", "iii", "iv", "v",
)
#: Named entities and their letters; the ampersand's comes last, so nothing is decoded twice.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&rsquo;", "\u2019"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&bull;", "\u2022"), ("&amp;", "&"),
)
_NUMBERED = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"

#: Codes and words of legal entities before a name, and levels behind a title.
_ENTITY_CODE = r"^(?:\d{2,6}|[A-Z]{2,3}\d{2,5})\s+(?=[A-Za-z])"
_ENTITY_WORD = r"(?i)\b(?:Inc|Incorporated|LLC|L\.?\s?L\.?\s?C|Corp|Corporation|Ltd|Limited|Co|Company|S\.A\.|GmbH)\b\.?"
_LEVEL = (
    r"(?i)\s*(?:\(IC\d+\)|\bIC\d+\b|\bL\d+\b|\bLevel\s+\d+\b|\bLvl\.?\s*\d+\b|[-–]\s*Level\s+\d+|[-–]\s*L\d+|\bI{1,3}V?\b|\bVII?\b)\s*$"
)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _letter(n: Column) -> Column:
    """The letter of a code point, by way of JSON's escapes; null where there is none."""
    escape = lambda x: F.concat(F.lit("\\u"), F.lpad(F.hex(x.cast("long")), 4, "0"))
    high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000) % 1024
    told = F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0xFFFF), escape(n)).when(n.between(0x10000, 0x10FFFF), F.concat(escape(high), escape(low)))
    return F.get_json_object(F.concat(F.lit('{"a":"'), told, F.lit('"}')), "$.a")


def unescaped(text: Column) -> Column:
    """HTML entities as characters: the common named ones, and numbered ones of any kind; a number without a letter stays as it is."""

    def one(mark: Column) -> Column:
        digits = F.regexp_replace(mark, "[&#;xX]", "")
        n = F.when(F.regexp_like(mark, F.lit("^&#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        return F.coalesce(_letter(n), mark)

    def whole(t: Column) -> Column:
        parts = F.zip_with(F.split(t, _NUMBERED, -1), F.regexp_extract_all(t, F.lit(_NUMBERED), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(one(m), F.lit(""))))
        t = F.when(F.contains(t, F.lit("&#")), F.array_join(parts, "")).otherwise(t)
        for entity, mark in ENTITIES:
            t = F.replace(t, F.lit(entity), F.lit(mark))
        return t

    return F.get(F.transform(F.array(text), whole), F.lit(0))  # what the text is made of is worked out once


def without_entity_code(company: Column) -> Column:
    """Drops a leading legal-entity code, if a legal ending follows and more than that ending stays."""
    name = F.trim(company)
    rest = F.trim(F.regexp_replace(name, _ENTITY_CODE, ""))
    residue = F.regexp_replace(F.regexp_replace(rest, _ENTITY_WORD, ""), r"^[ ,.\-]+|[ ,.\-]+$", "")
    return F.when(F.regexp_like(name, F.lit(_ENTITY_CODE)) & F.regexp_like(name, F.lit(_ENTITY_WORD)) & (residue != ""), rest).otherwise(name)


def company_key(company: Column) -> Column:
    """The normal form of a company name: unescaped, without tags, codes, leading numbers and endings, in small letters."""
    name = without_entity_code(squeezed(F.regexp_replace(unescaped(company), "<[^>]+>", "")))
    name = F.when(F.regexp_like(name, F.lit(r"^\d+[.\-)\s]+\S")), F.regexp_replace(name, r"^\d+[.\-)\s]+", "")).otherwise(name)
    endings = "|".join(COMPANY_ENDINGS)
    return F.trim(F.regexp_replace(F.trim(F.lower(name)), rf"(?:[,\s]+(?:{endings})\.?\s*)+$", ""))


def title_key(title: Column) -> Column:
    """The normal form of a title: without one level ending, short forms written out, digits set apart, in small letters."""
    out = F.trim(F.regexp_replace(F.trim(title), _LEVEL, ""))
    for pattern, long in TITLE_SHORT_FORMS:
        out = F.regexp_replace(out, f"(?i){pattern}", long)
    out = F.regexp_replace(out, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")
    return F.lower(squeezed(out))


def posting_key(company: Column, title: Column) -> Column:
    """company|title; a posting's place is left out on purpose."""
    return F.concat_ws("|", company_key(company), title_key(title))


def match_title(title: Column) -> Column:
    """The form of a title that wanted titles are matched against; not the one its key is made of."""
    out = title
    for short, long in MATCH_SHORT_FORMS:
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    return F.lower(squeezed(F.regexp_replace(out, r"(?U)[^\w\s]+", " ")))


def phrase_pattern(words: str) -> str:
    return r"\b" + r"\s+".join(words.split()) + r"\b"


def loose_pattern(words: str, gap: int = 2) -> str:
    """The words in order, each whole, with up to `gap` words between."""
    return r"(?:^|\s)" + (r"(?:\s+\S+){0,%d}?\s+" % gap).join(words.split()) + r"(?:\s|$)"


def title_passes(title: Column, wanted: tuple[str, ...], unwanted: tuple[str, ...] = ()) -> Column:
    """Whether a title holds a wanted phrase, whole or loosely, and no unwanted one. Wanted ones in match form."""

    def passes(name: Column) -> Column:
        hit = F.lit(not wanted)
        for words in wanted:
            hit = hit | F.regexp_like(name, F.lit(phrase_pattern(words))) | F.regexp_like(name, F.lit(loose_pattern(words)))
        for words in unwanted:
            hit = hit & ~F.regexp_like(name, F.lit(phrase_pattern(words)))
        return hit

    return F.exists(F.array(match_title(title)), passes)  # the match form is made once, not once a phrase


def telling_words(text: Column) -> Column:
    """Words of three letters or digits and more, without the stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def body_mentions(words: Column, body: Column, stem: int = 5) -> Column:
    """Whether the beginning of any of the words is in the body."""
    low = F.lower(body)
    return F.exists(words, lambda w: F.contains(low, F.left(w, F.lit(stem))))


def is_target_role(title: Column, words: tuple[str, ...]) -> Column:
    """Whether a title has one of the words, whole; a null title hasn't."""
    return F.coalesce(F.regexp_like(title, F.lit(r"(?i)\b(?:" + "|".join(words) + r")\b")), F.lit(False))
