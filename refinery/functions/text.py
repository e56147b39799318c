"""Column expressions for the cleaning rules (all JVM-side, codegen-friendly).

Each rule takes a string Column and returns a Column; none of them uses a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() is true.
# Java's (?U)\s is the Unicode White_Space property, which lacks U+001C..U+001F,
# so those four separators are added explicitly.
_WS_CLASS = r"[\s\x{1c}-\x{1f}]"
_STRIP_RE = rf"(?U)^{_WS_CLASS}+|{_WS_CLASS}+$"


def ustrip(c: Column) -> Column:
    """Unicode-aware strip (Spark's trim only removes spaces)."""
    return F.regexp_replace(c, _STRIP_RE, "")


# ---------------------------------------------------------------------------
# date rule
# ---------------------------------------------------------------------------
# Fixed values (must match the reference): the accepted input formats, tried in
# this order, first success wins; output is year-month-day.
#   %Y-%m-%d, %m/%d/%Y, %d/%m/%Y, %Y/%m/%d, %d-%m-%Y, %m-%d-%Y, %B %d, %Y, %b %d, %Y
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december")
MONTH_ABBR = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# strptime's own regexes for the numeric directives (alternation order kept);
# a part is accepted iff it fully matches.
_Y = r"^[0-9]{4}$"
_M = r"^(1[0-2]|0[1-9]|[1-9])$"
_D = r"^(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])$"
# "%B %d, %Y" / "%b %d, %Y": format spaces match any run of whitespace and
# names are case-insensitive.
_NAMED = rf"(?iU)^([a-z]+){_WS_CLASS}+(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]),{_WS_CLASS}+([0-9]{{4}})$"

# Numeric formats grouped by separator, in trial order: (year, month, day) part positions.
_BY_SEP = {
    "-": ((0, 1, 2), (2, 1, 0), (2, 0, 1)),   # %Y-%m-%d, %d-%m-%Y, %m-%d-%Y
    "/": ((2, 0, 1), (2, 1, 0), (0, 1, 2)),   # %m/%d/%Y, %d/%m/%Y, %Y/%m/%d
}


def _iso(y: Column, m: Column, d: Column) -> Column:
    """year-month-day text for a real calendar day, else null. Like Python's
    strftime('%Y'), the year is not zero-padded; year 0 does not exist."""
    ok = (y >= 1) & F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    return F.when(ok, F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"),
                              F.lit("-"), F.lpad(d.cast("string"), 2, "0")))


def _numeric_date(s: Column, sep: str) -> Column:
    parts = F.split(s, "\\" + sep if sep == "/" else sep)
    p = [F.get(parts, i) for i in range(3)]
    three = F.size(parts) == 3
    out = None
    for yi, mi, di in _BY_SEP[sep]:
        shape = three & p[yi].rlike(_Y) & p[mi].rlike(_M) & p[di].rlike(_D)
        cand = F.when(shape, _iso(F.trim(p[yi]).cast("int"), F.trim(p[mi]).cast("int"), F.trim(p[di]).cast("int")))
        out = cand if out is None else F.coalesce(out, cand)
    return out


def _named_date(s: Column) -> Column:
    names = {n: i + 1 for i, n in enumerate(MONTH_NAMES)}
    names.update({n: i + 1 for i, n in enumerate(MONTH_ABBR)})
    lookup = F.create_map(*[x for n, i in names.items() for x in (F.lit(n), F.lit(i))])
    word = F.lower(F.regexp_extract(s, _NAMED, 1))
    month = F.element_at(lookup, word)
    day = F.trim(F.regexp_extract(s, _NAMED, 2)).try_cast("int")
    year = F.regexp_extract(s, _NAMED, 3).try_cast("int")
    return F.when(s.rlike(_NAMED) & month.isNotNull(), _iso(year, month, day))


def date_from_stripped(s: Column) -> Column:
    # cheap guards: only try the branch whose separator / leading letter is present
    return F.coalesce(F.when(F.instr(s, "-") > 0, _numeric_date(s, "-")),
                      F.when(F.instr(s, "/") > 0, _numeric_date(s, "/")),
                      F.when(F.instr(s, ",") > 0, _named_date(s)), s)


def standardize_date(c: Column) -> Column:
    """First format that parses wins; else the stripped text. Conf-independent
    (no datetime pattern parsing, so timeParserPolicy cannot change results)."""
    return date_from_stripped(ustrip(c.cast("string")))


# ---------------------------------------------------------------------------
# phone / email / text case
# ---------------------------------------------------------------------------
def phone_from_stripped(s: Column) -> Column:
    digits = F.regexp_replace(s, r"(?U)[^\d+]", "")
    return F.when(digits == "", s).otherwise(digits)


def standardize_phone(c: Column) -> Column:
    """Keep digits and '+' only; if nothing is left, the stripped text."""
    return phone_from_stripped(ustrip(c.cast("string")))


def standardize_email(c: Column) -> Column:
    return F.lower(ustrip(c.cast("string")))


def text_lower(c: Column) -> Column:
    return F.lower(ustrip(c.cast("string")))


def text_upper(c: Column) -> Column:
    return F.upper(ustrip(c.cast("string")))


# ---------------------------------------------------------------------------
# currency
# ---------------------------------------------------------------------------
# Characters removed before parsing.
CURRENCY_STRIP_CHARS = ",$€£"

# Python float() grammar (digits may be separated by single underscores), plus
# the inf/nan words; anything else is "unparsable" and becomes 0.0.
_DIGITS = r"[0-9](?:_?[0-9])*"
_FLOAT_RE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_SPECIAL_RE = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def parse_currency(c: Column) -> Column:
    """Remove , $ € £, parse as a float, round to 2 places; unparsable -> 0.0.

    Rounding reproduces Python's round(x, 2) exactly (see :func:`round2`).
    """
    return currency_from_stripped(ustrip(c.cast("string")))


def number_from_stripped(stripped: Column) -> Column:
    """The float a currency text denotes (unrounded), or null if unparsable."""
    s = ustrip(F.translate(stripped, CURRENCY_STRIP_CHARS, ""))
    plain = F.translate(s, "_", "")
    return F.when(s.rlike(_FLOAT_RE), plain.try_cast("double")) \
            .when(s.rlike(_SPECIAL_RE), F.lower(s).try_cast("double"))


def currency_from_number(num: Column) -> Column:
    return F.coalesce(round2(num), F.lit(0.0))


def currency_from_stripped(stripped: Column) -> Column:
    return currency_from_number(number_from_stripped(stripped))


def _split(a: Column) -> tuple[Column, Column]:
    """Veltkamp split of a double into high and low halves (exact)."""
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    return hi, a - hi


def round2(x: Column) -> Column:
    """Python's round(x, 2) on the exact binary value, as JVM expressions.

    Spark's round() rounds the shortest decimal form HALF_UP. The two differ
    only when that form is a 3-decimal tie (…5): then the exact binary value
    lies above, below or on the tie. Its side is the sign of a*1000 - M,
    computed exactly with an error-free product (Dekker/Veltkamp, no FMA
    needed); an exact tie rounds half-even, like Python.
    """
    a = F.abs(x)
    m = F.round(a * F.lit(1000.0)).cast("long")                 # candidate tie, in thousandths
    tie = (a < F.lit(9.0e12)) & (m % 10 == 5) & (m.cast("double") / F.lit(1000.0) == a)
    p = a * F.lit(1000.0)
    ah, al = _split(a)
    bh, bl = F.lit(1000.0), F.lit(0.0)                          # 1000 splits exactly
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl        # a*1000 = p + err exactly
    side = (p - m.cast("double")) + err                        # sign of a*1000 - M
    k = (m - 5) / 10                                            # lower 2-decimal candidate, in cents
    k = k.cast("long")
    cents = (F.when(side > 0, k + 1).when(side < 0, k)
              .otherwise(F.when(k % 2 == 0, k).otherwise(k + 1)))
    # From 9e12 on a double has few enough binary places for an exact fraction.
    whole = F.floor(a).cast("double")
    part = (a - whole) * F.lit(100.0)
    low = F.floor(part)
    up = (part - low > 0.5) | ((part - low == 0.5) & (low % 2 == 1))
    large = whole + (low + up.cast("long")).cast("double") / F.lit(100.0)
    large = F.when(x < 0, -large).otherwise(large)
    exact_tie = F.when(x < 0, -(cents.cast("double") / F.lit(100.0))).otherwise(cents.cast("double") / F.lit(100.0))
    return F.when(x.isNull(), F.lit(None).cast("double")) \
            .when(F.isnan(x) | (a == F.lit(float("inf"))), x) \
            .when(a >= F.lit(float(2 ** 52)), x).when(a >= F.lit(9.0e12), large) \
            .when(tie, exact_tie).otherwise(F.round(x, 2))


# ---------------------------------------------------------------------------
# rule table
# ---------------------------------------------------------------------------
RULES = {
    "date": standardize_date,
    "phone": standardize_phone,
    "email": standardize_email,
    "currency": parse_currency,
    "text_lower": text_lower,
    "text_upper": text_upper,
}

# The same rules applied to an already-stripped string column (lets an operator
# strip once in an earlier projection and keep the generated code small).
RULES_ON_STRIPPED = {
    "date": date_from_stripped,
    "phone": phone_from_stripped,
    "email": F.lower,
    "currency": currency_from_stripped,
    "text_lower": F.lower,
    "text_upper": F.upper,
}

# Value written for a null/empty field, per rule (unknown -> "").
DEFAULTS = {"date": "", "phone": "", "email": "", "currency": 0.0, "text_lower": "", "text_upper": ""}

# Rule auto-detection by field-name substring, checked in this order.
AUTO_DETECT = (
    ("date", ("date", "created", "updated", "timestamp")),
    ("phone", ("phone", "tel", "mobile")),
    ("email", ("email", "mail")),
    ("currency", ("price", "amount", "revenue", "value", "cost")),
)


def detect_rule(field: str) -> str | None:
    low = field.lower()
    for rule, words in AUTO_DETECT:
        if any(w in low for w in words):
            return rule
    return None


# The text of a float below 1e16 in shortest form: no exponent, no spare digits.
_FLOAT_REPR_RE = r"^-?(0|[1-9][0-9]*)\.([0-9]*[1-9]|0)$"


def currency_changed(original: Column, dtype: str, new: Column | None = None) -> Column:
    """``str(parse_currency(v)) != str(v)`` for a non-empty value."""
    if dtype in ("double", "float"):
        return round2(original) != original
    if dtype == "string" or dtype.startswith("decimal"):
        text = original.cast("string")
        new = parse_currency(text) if new is None else new
        exact = "decimal(38,18)"  # digits compared as digits, so 17 of them do not pass for 16
        same = text.rlike(_FLOAT_REPR_RE) & (F.abs(new) < F.lit(1e16)) \
            & (text.try_cast(exact) == new.try_cast(exact))
        return ~F.coalesce(same, F.lit(False))
    # ints print without ".0" so they always change
    return F.lit(True)
