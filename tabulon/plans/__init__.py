"""All named queries of the engine."""

from tabulon.plans import documents, filings, finding, folds, governance, quality, relational, sectioned, statements
from tabulon.plans.registry import PLANS, oracle_sql, plan, queries

__all__ = ["PLANS", "documents", "filings", "finding", "folds", "governance", "oracle_sql", "plan", "quality", "queries", "relational", "sectioned", "statements"]
