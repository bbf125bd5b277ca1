"""Vocabularies and rank tables of the posting domain. All are fixed values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

PIPELINE_STATUSES = (
    "discovered", "reviewing", "applied", "phone_screen", "technical", "onsite",
    "offer", "accepted", "rejected", "withdrawn", "archived", "dismissed",
)
HIDDEN_STATUSES = ("archived", "withdrawn", "dismissed", "rejected")
TERMINAL_STATUSES = ("archived", "rejected", "withdrawn", "dismissed")
#: Statuses that show through expiry and staleness; `interviewing` is listed though it is no pipeline status.
STICKY_STATUSES = ("applied", "phone_screen", "interviewing", "offer", "rejected", "withdrawn")
PROTECTED_STATUSES = ("applied", "phone_screen", "technical", "onsite", "offer", "accepted")
CLASSES = ("apply", "consider", "skip", "reject", "low_signal")
AXES = ("title_fit", "location_fit", "comp_fit", "domain_match", "seniority_match", "skills_match")
WORKPLACE_TYPES = ("REMOTE", "HYBRID", "ONSITE", "UNSPECIFIED")
STAGE_RANK = {"applied": 1, "phone_screen": 2, "technical": 3, "onsite": 4, "offer": 5, "accepted": 6}
MERGE_STATUS_RANK = {
    "offer": 9, "accepted": 8, "technical": 7, "onsite": 6, "phone_screen": 5,
    "applied": 4, "reviewing": 3, "discovered": 2, "archived": 1,
}
PRECISION_RANK = {"exact": 3, "approximate": 2, "proxy": 1}
PROVENANCE_RANK = {"ats_structured": 4, "jd_regex": 3, "llm_extract": 2, "email_snippet": 1, "feed_string": 1}
CLASS_ORDER = {"apply": 0, "consider": 1, "skip": 2, "reject": 3, "low_signal": 4}
TERMINAL_TIERS = ("exhausted", "agentic", "agentic_exhausted")
FREE_PROVIDERS = ("F",)


def rank(table: Mapping[str, int], key: Column, default: int = 0) -> Column:
    """The rank of a key by a fixed table; unknown and null keys get the default."""
    out = F.lit(default)
    for name, value in reversed(list(table.items())):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out
