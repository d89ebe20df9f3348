"""Secret-like content: fixed token shapes, then quoted values of telling names with high entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeline.functions.text import entropy

#: Public shapes of keys and tokens, in the order they are tried.
SHAPES = (
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack-token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
)
#: Quoted values of telling names, and the bits per character from which they count.
ASSIGNMENT = r"""(?i)\b(?:api[_-]?key|secret|token|password|passwd|auth)\w*\s*[:=]\s*['"]([A-Za-z0-9_\-/+=]{32,})['"]"""
MIN_ENTROPY = 3.5


def assigned_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ASSIGNMENT), 1)


def secret_rule(text: Column) -> Column:
    """Name of the first rule that the text meets, else null."""
    case = F.when(text.rlike(SHAPES[0][1]), SHAPES[0][0])
    for name, shape in SHAPES[1:]:
        case = case.when(text.rlike(shape), name)
    return case.when(F.exists(assigned_values(text), lambda v: entropy(v) > MIN_ENTROPY), "secret-assignment")
