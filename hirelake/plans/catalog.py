"""All queries of the posting domain, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.plans import catalog_checks, catalog_dashboard, catalog_extra, catalog_more, catalog_pages, catalog_rest, catalog_rounds, catalog_state
from hirelake.plans.views import whole

_PARTS = [catalog_dashboard.R, catalog_more.R, catalog_extra.R, catalog_state.R, catalog_pages.R, catalog_rounds.R, catalog_rest.R, catalog_checks.R]
QUERIES = whole(*(part.queries for part in _PARTS))
ORACLE_SQL = whole(*(part.oracle for part in _PARTS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion funnel."""
    return catalog_dashboard.q_funnel(spark, sf_dir)
