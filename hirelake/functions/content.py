"""Gates on titles and bodies, as column expressions: a reason code, or null where nothing is wrong."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hirelake.functions.names import body_mentions, telling_words, unescaped

#: Beginnings of bodies that are page furniture, and their least length.
JUNK_BEGINNINGS = ("sign in", "loading", "open roles at", "skip to content", "cookie", "privacy policy", "404")
LEAST_BODY = 200
#: Windows and lengths of the content rules.
HEAD, CLEAN_LENGTH, OVERLAP_LENGTH, OVERLAP_WORDS, LONGEST_TITLE = 400, 600, 300, 2, 140
#: Marks of metadata in a title.
BLOB_MARKS = ("posted ", "apply by", "agency", "post level", "job title", "more accessible", "description ", "required:", "responsibilities")
#: Patterns of the content rules, in order.
BLOCK_PAGE = (
    r"from wikipedia, the free encyclopedia|request denied|are you a robot|verify you are (?:human|not a robot)|attention required"
    r"|just a moment|checking your browser|you have been blocked|access (?:to this page )?(?:has been )?denied|enable javascript"
    r"|please enable (?:js|javascript|cookies)|unusual traffic from your|complete the security check|ddos protection"
)
LISTING_PAGE = r"\b\d[\d,]{0,4}\+?\s+[\w\s,&/+.\-]{0,40}?\bjobs\s+in\b"
NOT_FOUND_PAGE = (
    r"\b404\s+(?:error|not\s+found|page)|\b(?:error|http)\s+404\b|\bpage\s+not\s+found\b"
    r"|the\s+page\s+you\s+(?:requested|are\s+looking\s+for)|\bpage\s+(?:cannot|can(?:'|’)?t)\s+be\s+found\b|\b410\s+gone\b"
)
EXPIRED_BODY = (
    r"\bthis\s+(?:job|position|posting|role|listing|vacancy|opening)\s+(?:is|has\s+been)\s+"
    r"(?:no\s+longer\s+available|no\s+longer\s+active|filled|closed|expired)"
    r"|\bthis\s+(?:job|position|posting)\s+is\s+no\s+longer\b|\bno\s+longer\s+accepting\s+applications\b"
    r"|the\s+job\s+you\s+are\s+trying\s+to\s+apply\s+for\s+has\s+been\s+filled|\bthis\s+job\s+has\s+closed\b"
    r"|\bposition\s+has\s+been\s+filled\b|\bjob\s+expired\b"
)
BODY_SHAPE = (
    r"\bresponsibilities\b|\bqualifications\b|\brequirements\b|what\s+you(?:'|’)?(?:ll|\s+will)\s+do"
    r"|what\s+we(?:'|’)?(?:re|\s+are)\s+looking\s+for|about\s+(?:the|this)\s+role|we(?:'|’)?(?:re|\s+are)\s+looking\s+for"
    r"|minimum\s+qualifications|preferred\s+qualifications|who\s+you\s+are|your\s+(?:impact|role|responsibilities)|in\s+this\s+role"
    r"|the\s+ideal\s+candidate|what\s+you(?:'|’)?(?:ll|\s+will)\s+bring|you\s+will\s+be\s+responsible|key\s+(?:responsibilities|duties)"
    r"|essential\s+(?:functions|duties)|job\s+(?:description|summary|duties)|role\s+(?:overview|summary)|day[\s-]to[\s-]day|duties\s+include"
)
LISTING_TILE = r"(?i)^\s*\d[\d,]*\+?\s+.*\b(?:jobs?|positions?|openings?|roles?|opportunities|results)\s*$"
NON_POSTING = (
    r"(?i)\b(?:talent\s+(?:network|community|pool|connection|pipeline)|join\s+(?:our|the)\s+talent|general\s+application|open\s+application"
    r"|speculative\s+application|spontaneous\s+application|unsolicited\s+application|future\s+(?:opportunities|openings|vacancies)"
    r"|expression\s+of\s+interest|candidate\s+pool|stay\s+connected)\b"
)
DATE_IN_TITLE = (
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
)
POSTED_AGO = r"(?i)Posted\s+\d+\+?\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b"
CALL_TO_ACTION = (
    r"(?i)\b(?:view\s+job|view\s+details|view\s+posting|view\s+role|apply\s+now|apply\s+today|apply\s+here|quick\s+apply|easy\s+apply"
    r"|save\s+job|saved\s+job|learn\s+more|see\s+details|read\s+more|show\s+more|please\s+wait|load\s+more)\b"
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\n\r\t]"


def _like(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def is_junk_body(body: Column) -> Column:
    """Too short, or beginning like page furniture."""
    text = F.trim(F.coalesce(body, F.lit("")))
    head = F.lower(F.left(text, F.lit(200)))
    out = F.length(text) < LEAST_BODY
    for beginning in JUNK_BEGINNINGS:
        out = out | F.startswith(head, F.lit(beginning))
    return out


def is_listing_tile(title: Column) -> Column:
    return _like(title, LISTING_TILE)


def is_metadata_blob(title: Column) -> Column:
    low = F.lower(title)
    out = F.length(title) > LONGEST_TITLE
    for mark in BLOB_MARKS:
        out = out | F.contains(low, F.lit(mark))
    out = out | _like(title, r"\$\s*\d") | _like(title, r"\d{4,}\s*\|\s*[A-Z]")
    return F.coalesce(out, F.lit(False))


def title_reason(title: Column) -> Column:
    """title_invalid_shape, title_non_posting or null, of a cleaned title."""
    shape = F.trim(F.coalesce(title, F.lit(""))) == ""
    for pattern in (DATE_IN_TITLE, POSTED_AGO, CALL_TO_ACTION, CONTROL):
        shape = shape | _like(title, pattern)
    return F.when(shape, "title_invalid_shape").when(_like(title, NON_POSTING), "title_non_posting")


def body_reject(body: Column, title: Column | None = None) -> Column:
    """struct(reason, signal) where the body can't be this posting's, else null; the first rule that fits wins."""
    text = F.lower(F.trim(body))
    head = F.left(text, F.lit(HEAD))
    pair = lambda reason, signal: F.struct(F.lit(reason).alias("reason"), F.lit(signal).alias("signal"))
    out = (
        F.when(F.coalesce(body, F.lit("")) == "", None)
        .when(_like(head, BLOCK_PAGE), pair("jd_full_offsite", "head_block_or_wiki"))
        .when(_like(head, LISTING_PAGE), pair("jd_full_offsite", "listing_index"))
        .when(_like(head, NOT_FOUND_PAGE), pair("jd_full_offsite", "not_found"))
        .when(_like(text, EXPIRED_BODY), pair("jd_full_expired", "expired_or_filled"))
    )
    if title is None:
        return out
    words = telling_words(title)
    apart = (F.length(F.trim(body)) >= OVERLAP_LENGTH) & (F.size(words) >= OVERLAP_WORDS) & ~body_mentions(words, text)
    return out.when(F.coalesce(apart, F.lit(False)), pair("jd_full_offsite", "title_zero_overlap"))


def body_verdict(body: Column, title: Column) -> Column:
    """reject, clean or ambiguous."""
    text = F.lower(F.trim(body))
    clean = _like(text, BODY_SHAPE) & body_mentions(telling_words(title), text) & (F.length(F.trim(body)) >= CLEAN_LENGTH)
    return F.when(body_reject(body, title).isNotNull(), "reject").when(F.coalesce(clean, F.lit(False)), "clean").otherwise("ambiguous")


def without_repeated_blocks(text: Column) -> Column:
    """Blocks (set apart by an empty line) whose letters occurred before are dropped; the first stays."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    keys = F.transform(blocks, lambda b: F.lower(F.regexp_replace(b, r"\s+", " ")))
    return F.array_join(F.filter(blocks, lambda b, i: F.array_position(keys, F.get(keys, i)) == i + 1), "\n\n")


def scrubbed(text: Column) -> Column:
    """Without recipient header lines; mail addresses as a mark."""
    out = F.regexp_replace(text, r"(?im)^(?:to|cc|bcc|delivered-to|x-original-to|return-path):[^\n]*\n?", "")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email]")


def mail_kind(subject: Column, body: Column) -> Column:
    """rejection, interview, confirmation or null, by the first list with a phrase in the mail."""
    text = F.lower(F.concat_ws(" ", subject, body))
    out = None
    for kind, phrases in MAIL_PHRASES:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(text, F.lit(phrase))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


#: Phrases of application mail, in order of the kinds.
MAIL_PHRASES = (
    ("rejection", (
        "unfortunately", "not moving forward", "other candidates", "not selected", "position has been filled", "no longer moving forward",
        "decided not to proceed", "other direction", "will not be moving forward", "not proceed", "filled the position",
    )),
    ("interview", (
        "interview", "phone screen", "next steps", "technical interview", "schedule time", "meet with", "speak with", "chat with",
        "call with", "video call", "hiring process",
    )),
    ("confirmation", (
        "application received", "thank you for applying", "application confirmation", "we received your application",
        "successfully submitted", "received your application", "thank you for your application",
    )),
)


#: Marks of HTML in a text.
HTML_SIGNAL = r"(?i)</?(?:p|div|br|ul|ol|li|span|strong|em|b|i|h[1-6]|table|a)\b[^>]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);"
#: Tails of cards behind a title.
CARD_TAIL = r"(?i)\s*(?:posted\s+(?:\d+\+?\s+\w+\s+ago|today|yesterday).*|\d+\+?\s+(?:days?|hours?|weeks?|months?)\s+ago.*|(?:apply now|view job|learn more|save job|easy apply).*)$"
#: Words of an error that tell of credentials.
CREDENTIAL_WORDS = ("rejected", "401", "403", "expired", "invalid", "unauthorized")
#: Tiers of enrichment in order.
TIERS = ("static", "search", "browser", "exhausted", "agentic", "agentic_exhausted")


def html_to_text(html: Column) -> Column:
    """Text without tags: script, style and comments go, blocks and items become lines, entities their letters."""
    text = F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|section|article|ul|ol|table|h[1-6])\s*>", "\n\n")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:tr|li)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "")
    text = unescaped(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\u00a0]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def clean_html(html: Column) -> Column:
    """Text of HTML without its repeated blocks."""
    return without_repeated_blocks(html_to_text(html))


def plain_body(body: Column) -> Column:
    """The body as text where it shows signs of HTML, else as it is."""
    return F.when(F.regexp_like(body, F.lit(HTML_SIGNAL)), html_to_text(body)).otherwise(body)


def clean_title(title: Column) -> Column:
    """Without a card's tail, a workplace, city or request number behind it, and logo letters before it; the title itself if nothing stays."""
    out = F.regexp_replace(title, CARD_TAIL, "")
    out = F.regexp_replace(out, r"(?i)\s*[-–—|·•]\s*(?:remote|hybrid|on-?site|anywhere|multiple|worldwide).*$", "")
    out = F.regexp_replace(out, r"\s+[-–—|·•]\s+[A-Z][A-Za-z. ]+,\s*(?:[A-Z]{2}|[A-Z][a-z]+(?: [A-Z][a-z]+)*)$", "")
    out = F.regexp_replace(out, r"(?<=[a-z)])[A-Z]{2,}\d+.*$", "")
    out = F.regexp_replace(out, r"(?<=[a-z)])[A-Z]{2,}(?:,\s*[A-Za-z][A-Za-z]+)+$", "")
    out = F.regexp_replace(out, r"^[A-Z]{1,2}(?=[A-Z][a-z]{2,})", "")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), title)


def is_valid_posting(title: Column, company: Column, url: Column) -> Column:
    """Title, company and URL aren't blank, and the title has 3 to 200 characters."""
    some = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    return some(title) & some(company) & some(url) & F.length(F.trim(title)).between(3, 200)


def title_bleeds(title: Column, locations: Column) -> Column:
    """Whether a word of a location stands in the title behind its first closing bracket."""
    after = F.lower(F.regexp_extract(title, r"(?s)\)(.*)$", 1))
    words = F.flatten(F.transform(locations, lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z]{2,}"), F.lit(0))))
    return F.coalesce((after != "") & F.exists(words, lambda w: F.contains(after, F.lower(w))), F.lit(False))


#: Phrases of lines of a mail that are neither title nor company.
SKIPPED = (
    "here's your", "weekly update", "new roles", "good fit", "apply early", "stand out", "unsubscribe", "view in browser", "copyright", "privacy policy", "terms of service",
    "email preferences", "manage your", "you received", "you're receiving", "click here",
)


def is_candidate_line(line: Column, skipped: tuple[str, ...] = SKIPPED, least: int = 3, most: int = 150) -> Column:
    """Whether a line of a mail may be a title or a company: of a fit length, no URL, none of the phrases."""
    text = F.trim(line)
    out = F.length(text).between(least, most) & ~F.startswith(text, F.lit("http")) & ~(F.startswith(text, F.lit("(")) & F.contains(text, F.lit("http")))
    for phrase in skipped:
        out = out & ~F.contains(F.lower(text), F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def error_kind(error: Column) -> Column:
    """credential for an error of access, else degraded."""
    return F.when(F.regexp_like(F.lower(error), F.lit("|".join(CREDENTIAL_WORDS))), "credential").otherwise("degraded")


def resume_index(tier: Column) -> Column:
    """The place of the tier to run next: 0 without one, behind the last for one that isn't known."""
    out = F.lit(len(TIERS))
    for k, name in enumerate(TIERS):
        out = F.when(tier == name, k + 1).otherwise(out)
    return F.when(tier.isNull(), 0).otherwise(out)


def may_enrich(tier: Column, terminal: tuple[str, ...] = ("exhausted", "agentic", "agentic_exhausted")) -> Column:
    """Whether the tier isn't a last one; no tier at all is none."""
    return tier.isNull() | ~tier.isin(*terminal)


def resolved_view(reasons: Column, locations: Column, view: str = "hide") -> Column:
    """hide: rows without reasons and unresolved locations; only: the others; all. Any other view is hide."""
    none = F.array().cast("array<string>")
    clear = (F.size(F.coalesce(reasons, none)) == 0) & ~F.coalesce(F.exists(locations, lambda x: x["unresolved"]), F.lit(False))
    return F.lit(True) if view == "all" else ~clear if view == "only" else clear


def title_and_company(title: Column) -> Column:
    """struct(title, company) of "title - company"; without a dash the company is null."""
    parts = F.split(title, r"\s+[-–|]\s+", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("title"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("company"))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The parsed JSON, or the default where it is null, broken or the JSON null. (A parser that is lenient makes a struct of nulls of broken text.)"""
    sound = F.coalesce(F.get_json_object(text, "$"), F.lit("null")) != "null"
    return F.coalesce(F.when(sound, F.from_json(text, schema)), default)


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed value that equals it but for case, space, hyphens and underscores, else one that begins with it or it with; null for none."""
    norm = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "")
    own = norm(value)
    exact = [F.when(own == norm(F.lit(a)), a) for a in allowed]
    near = [F.when((own != "") & (F.startswith(norm(F.lit(a)), own) | F.startswith(own, norm(F.lit(a)))), a) for a in allowed]
    return F.coalesce(*exact, *near)


def surface_of(source: Column) -> Column:
    """ats for ats:*, careers for careers and careers:*, else email."""
    return F.when(F.startswith(source, F.lit("ats:")), "ats").when((source == "careers") | F.startswith(source, F.lit("careers:")), "careers").otherwise("email")


def shifted_hours(hours: Column, by: int = 1) -> Column:
    """Hours of a schedule, moved and sorted."""
    return F.array_sort(F.transform(hours, lambda h: (h + by) % 24))


def remote_flag(value: Column) -> Column:
    """A vendor's remote field, as text: null stays unknown; false, 0 and empty are false, all else is true."""
    return F.when(value.isNotNull(), ~F.lower(F.trim(value)).isin("", "false", "0", "{}", "[]", "null"))


def is_blocked_brand(name: Column, brands: tuple[str, ...]) -> Column:
    """Whether the name is one of the brands, but for case and marks."""
    norm = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.coalesce(norm.isin(*["".join(c for c in b.lower() if c.isalnum()) for b in brands]), F.lit(False))


def without_chrome(text: Column, markers: tuple[str, ...]) -> Column:
    """The text before the earliest of the markers of a page's tail."""
    places = [F.nullif(F.locate(m, text), F.lit(0)) for m in markers]
    first = F.least(*places, F.lit(None).cast("int")) if places else F.lit(None).cast("int")
    return F.when(first.isNotNull(), F.trim(F.substr(text, F.lit(1), first - 1))).otherwise(text)
