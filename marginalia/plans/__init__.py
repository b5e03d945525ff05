"""Registered queries: operators bound to the supplied tables, each with the SQL that checks it."""

from marginalia.plans import application, audits, documents, domains, ordered, planning, references, relational, rules, streams, text  # noqa: F401
from marginalia.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
