"""The board: filters from parameters, an allow-list of orders, and target sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.vocab import CLASS_ORDER, HIDDEN_STATUSES, WORKPLACE_TYPES, rank


@dataclass(frozen=True)
class Filters:
    """All of them are optional; they narrow together. A null status is hidden unless asked for otherwise."""

    status: str | Sequence[str] | None = None
    show_hidden: bool = False
    location: str | None = None
    hide_stale: bool = False
    classification: str | Sequence[str] | None = None
    salary_min: float | None = None
    source: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    country: str | None = None
    workplace_type: str | None = None
    unresolved: str = "hide"


def _many(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def conditions(f: Filters, columns: Sequence[str]) -> list[Column]:
    """One condition for each filter that is set and whose columns are there."""
    c, out = F.col, []
    status = c("computed_status") if "computed_status" in columns else c("status")
    if f.status:
        out.append(status.isin(*_many(f.status)))
    elif not f.show_hidden:
        out.append(~c("status").isin(*HIDDEN_STATUSES))
    if f.location:
        out.append(F.contains(F.lower("location"), F.lit(f.location.lower())))
    if f.hide_stale:
        out.append(~F.coalesce(c("is_stale"), F.lit(False)))
    if f.classification:
        out.append(c("classification").isin(*_many(f.classification)))
    if f.salary_min is not None:
        out.append(c("salary") >= f.salary_min)
    if f.source:
        out.append(F.exists("sources", lambda s: F.lower(s) == f.source.lower()))
    if f.date_from:
        out.append(c("first_seen") >= F.lit(f.date_from).cast("timestamp_ntz"))
    if f.date_to:
        out.append(c("first_seen") < F.date_add(F.lit(f.date_to).cast("date"), 1))
    if f.country and len(f.country.strip()) == 2:
        out.append(c("country_code") == f.country.strip().upper())
    if f.workplace_type in WORKPLACE_TYPES:
        out.append(c("workplace_type") == f.workplace_type)
    if "unresolved_reasons" in columns and f.unresolved != "all":
        some = F.size(F.coalesce("unresolved_reasons", F.array().cast("array<string>"))) > 0
        out.append(some if f.unresolved == "only" else ~some)
    return out


def orders(columns: Sequence[str]) -> dict[str, list[Column]]:
    """The orders that may be asked for."""
    named = {"salary": F.col("salary"), "first_seen": F.col("first_seen"), "company": F.lower("company"), "title": F.lower("title"), "status": F.col("status")}
    out = {k: [v] for k, v in named.items() if k in columns}
    if "classification" in columns:
        out["classification"] = [rank(CLASS_ORDER, F.col("classification"), 9)]
    if "composite" in columns:
        out["score"] = [F.col("composite")]
    return out


def board(jobs: DataFrame, filters: Filters, sort_by: str = "score", descending: bool = True, limit: int = 100, key: str = "dedup_key") -> DataFrame:
    """The page: filtered, in an allowed order (an unknown one: the first allowed), then by key. The limit is the page."""
    where = conditions(filters, jobs.columns)
    allowed = orders(jobs.columns)
    by = allowed.get(sort_by) or allowed.get("score") or next(iter(allowed.values()))
    rows = jobs.where(reduce(lambda a, b: a & b, where)) if where else jobs
    return rows.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_last() for c in by], F.col(key)).limit(limit)
