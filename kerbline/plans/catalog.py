"""Registered queries of the marketplace engine, each with SQL that gives the same rows."""

from __future__ import annotations

from kerbline.plans import browse, ingest, stored, texts  # noqa: F401  they register their queries
from kerbline.plans.browse import featured_feed
from kerbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "featured_feed"]
