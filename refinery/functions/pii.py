"""PII patterns and field-name families as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must match the reference): PII regexes, in the order they are
# tried; in "first" mode only the first one that matches a value is substituted.
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)

# Field-name keyword families; the first family with a keyword
# contained in the lower-cased field name gives the field's PII type.
FIELD_FAMILIES = (
    ("email", ("email", "mail", "e_mail")),
    ("phone", ("phone", "tel", "mobile", "fax")),
    ("name", ("name", "first_name", "last_name", "full_name", "contact_name")),
    ("address", ("address", "street", "city", "zip", "postal")),
    ("ssn", ("ssn", "social_security", "tax_id", "national_id")),
)

DEFAULT_REPLACEMENT = "[REDACTED]"

# Order used by mode="all": longer, more specific patterns first so a card
# number is not half-eaten by the phone pattern.
ALL_MODE_ORDER = ("email", "credit_card", "ssn", "ip_address", "phone")

_BY_NAME = dict(PII_PATTERNS)


def java_pattern(name: str) -> str:
    # (?U): \b, \d and \s follow Unicode like Python's re does for str patterns.
    return "(?U)" + _BY_NAME[name]


def quote_replacement(text: str) -> str:
    """Escape a literal for use as a Java regex replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


# One pattern per family, for Spark and for plan time alike.
_FIELD_RULES = tuple((kind, "|".join(words)) for kind, words in FIELD_FAMILIES)


def classify_field_col(name: Column) -> Column:
    """PII type of a column name: the first family found in it, else null."""
    return F.coalesce(*(F.when(name.rlike(f"(?i){pattern}"), F.lit(kind)) for kind, pattern in _FIELD_RULES))


def classify_field(field: str) -> str | None:
    """The same for one name."""
    return next((kind for kind, pattern in _FIELD_RULES if re.search(pattern, field, re.IGNORECASE)), None)


def first_match_index(c: Column) -> Column:
    """1-based index of the first PII pattern found in ``c`` (null if none).

    Every pattern but e-mail needs a digit and e-mail needs an '@', so two cheap
    scans skip the regexes for most text. Computed once, in its own projection,
    and reused by the value, count and type columns.
    """
    has_at = F.instr(c, "@") > 0
    has_digit = c.rlike(r"(?U)\d")
    out = None
    for i, (name, _) in enumerate(PII_PATTERNS, 1):
        guard = has_at if name == "email" else has_digit
        hit = guard & c.rlike(java_pattern(name))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def replace_by_index(c: Column, idx: Column, replacement: str = DEFAULT_REPLACEMENT) -> Column:
    """Substitute only the pattern chosen by :func:`first_match_index`."""
    repl = quote_replacement(replacement)
    out = None
    for i, (name, _) in enumerate(PII_PATTERNS, 1):
        step = F.regexp_replace(c, java_pattern(name), repl)
        out = F.when(idx == i, step) if out is None else out.when(idx == i, step)
    return out.otherwise(c)


def type_by_index(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _ in PII_PATTERNS]), idx)


def redact_first(c: Column, replacement: str = DEFAULT_REPLACEMENT) -> tuple[Column, Column]:
    """Reference semantics: substitute only the first pattern that matches.

    Returns (new value, matched type or null). Operators should stage
    :func:`first_match_index` in an earlier projection instead (see redact).
    """
    idx = first_match_index(c)
    return replace_by_index(c, idx, replacement), type_by_index(idx)


def redact_all(c: Column, replacement: str = DEFAULT_REPLACEMENT) -> tuple[Column, Column]:
    """Substitute every pattern (specific ones first). Returns (value, array of types)."""
    repl = quote_replacement(replacement)
    value = c
    kinds = []
    for name in ALL_MODE_ORDER:
        p = java_pattern(name)
        kinds.append(F.when(value.rlike(p), F.lit(name)))
        value = F.regexp_replace(value, p, repl)
    return value, F.filter(F.array(*kinds), lambda x: x.isNotNull())
