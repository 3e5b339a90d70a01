"""Question routing and dispatch, set-wise over a question table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import WS
from murmur.resources.words import ROUTE_RULES, VALID_ROUTES


def route(question: Column, rules=ROUTE_RULES) -> Column:
    """First route whose keyword pattern occurs in the lower-cased question;
    rag_agent otherwise."""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit("rag_agent")
    for name, pattern in reversed(rules):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def normalise_route(r: Column) -> Column:
    """trim + lower; anything outside the six routes becomes rag_agent."""
    clean = F.lower(F.regexp_replace(r, "^[" + WS + "]+|[" + WS + "]+$", ""))
    return F.when(clean.isin(VALID_ROUTES), clean).otherwise(F.lit("rag_agent"))


def split_by_route(questions: DataFrame, route_col: str = "route") -> dict[str, DataFrame]:
    return {name: questions.filter(F.col(route_col) == name) for name in VALID_ROUTES}
