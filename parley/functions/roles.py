"""Role spellings looked up in one constant map."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import ROLE_MAP, SHAREGPT_MAP
from .text import strip


def standard_role(role: Column) -> Column:
    """user / assistant / system for a known spelling, otherwise NULL."""
    return F.try_element_at(F.expr(ROLE_MAP), F.lower(strip(role)))


def normalize_role(role: Column) -> Column:
    """Canonical role for a known spelling, the input otherwise."""
    return F.coalesce(standard_role(role), role)


def expected_role(index: Column) -> Column:
    """Role a well-formed entry has at a 0-based position."""
    return (
        F.when(index == 0, "system")
        .when(index % 2 == 1, "user")
        .otherwise("assistant")
    )


def sharegpt_role(role: Column) -> Column:
    """human / gpt / system for a known spelling, otherwise NULL."""
    return F.try_element_at(F.expr(SHAREGPT_MAP), F.lower(strip(role)))
