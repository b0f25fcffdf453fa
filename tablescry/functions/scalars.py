"""Column -> Column coercions and text helpers. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that means "missing".
MISSING_WORDS = (
    "na", "n/a", "n.a.", "nan", "null", "none", "nil", "missing",
    "unknown", "undefined", "?", "--", "#n/a", "not available",
)

# Every character Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Java's own parser also takes "12d" and "0x1p3", so the shape is tested first.
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

MAX_UNIT_LETTERS = 3
MAX_MARKER_LENGTH = 6

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_WORD = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
CLOCK = r"(?:[ T]+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?))?"


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_date_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text_type(data_type: T.DataType) -> bool:
    """Text is what is neither number, date nor boolean; nested types are not analysed."""
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_analysable(data_type: T.DataType) -> bool:
    return (
        is_numeric_type(data_type)
        or is_date_type(data_type)
        or is_text_type(data_type)
        or isinstance(data_type, T.BooleanType)
    )


def strip_ws(c: Column) -> Column:
    """Strip every kind of white space at both ends (a bare SQL trim takes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_missing_word(c: Column) -> Column:
    return F.lower(strip_ws(c)).isin(*MISSING_WORDS)


def variant_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def parse_number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER_SHAPE) & (F.abs(value) < float("inf")), value)


def to_number(c: Column, data_type: T.DataType) -> Column:
    """Number or null. NaN and the infinities count as missing; dates are not numbers."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        value = c.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if is_numeric_type(data_type) or isinstance(data_type, T.BooleanType):
        return c.cast("double")
    if is_text_type(data_type):
        return parse_number(strip_ws(c))
    return F.lit(None).cast("double")


def present(c: Column, data_type: T.DataType) -> Column:
    """The column with NaN turned into null, so that missing means one thing."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def _stamp(year: Column, month: Column, day: Column, clock: Column) -> Column:
    joined = F.concat_ws("-", year, month, day)
    return F.concat_ws(" ", joined, F.when(clock != "", clock)).try_cast("timestamp_ntz")


def begins_like_a_date(stripped: Column) -> Column:
    """One cheap test that every layout ``parse_stamp`` knows passes."""
    return stripped.rlike(r"^([0-9]{1,4}[-/. ]|[0-9]{8}$|" + MONTH_WORD + "[ .-])")


def parse_stamp(text: Column) -> Column:
    """Date text in mixed layouts -> timestamp_ntz or null.

    The layout is recognised by shape first and only then cast, so a value that
    is no date costs one failed match. ``a/b/yyyy`` is month-first unless the
    first part cannot be a month.
    """
    t = strip_ws(text)
    iso = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}.*)?$"
    slashed = r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})" + CLOCK + "$"
    parts = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})" + CLOCK + "$"
    packed = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    day_word = r"^([0-9]{1,2})[ -]+" + MONTH_WORD + r"[ ,.-]+([0-9]{4})" + CLOCK + "$"
    word_day = "^" + MONTH_WORD + r"[ .-]+([0-9]{1,2})(?:st|nd|rd|th)?[ ,]+([0-9]{4})" + CLOCK + "$"

    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(t, pattern, index)

    def month_number(word: Column) -> Column:
        return ((F.instr(F.lit(MONTHS), F.lower(F.substring(word, 1, 3))) + 2) / 3).cast("int").cast("string")

    month_first = group(parts, 1).try_cast("int") <= 12
    return F.when(
        begins_like_a_date(t),
        F.when(t.rlike(iso), t.try_cast("timestamp_ntz"))
        .when(t.rlike(slashed), _stamp(group(slashed, 1), group(slashed, 2), group(slashed, 3), group(slashed, 4)))
        .when(
            t.rlike(parts),
            _stamp(
                group(parts, 3),
                F.when(month_first, group(parts, 1)).otherwise(group(parts, 2)),
                F.when(month_first, group(parts, 2)).otherwise(group(parts, 1)),
                group(parts, 4),
            ),
        )
        .when(t.rlike(packed), _stamp(group(packed, 1), group(packed, 2), group(packed, 3), F.lit("")))
        .when(
            t.rlike(day_word),
            _stamp(group(day_word, 3), month_number(group(day_word, 2)), group(day_word, 1), group(day_word, 4)),
        )
        .when(
            t.rlike(word_day),
            _stamp(group(word_day, 3), month_number(group(word_day, 1)), group(word_day, 2), group(word_day, 4)),
        ),
    )


def to_stamp(c: Column, data_type: T.DataType) -> Column:
    """Timestamp without zone, or null. Numbers are never read as dates."""
    if is_date_type(data_type):
        return c.cast("timestamp_ntz")
    if is_text_type(data_type):
        return parse_stamp(c)
    return F.lit(None).cast("timestamp_ntz")


def as_ordinal(c: Column, data_type: T.DataType) -> Column:
    """A number that grows with the value, whatever the session's time zone.

    Clock changes make zoned casts of local times step back, so a timestamp
    without zone is counted by its own day and clock.
    """
    if is_numeric_type(data_type):
        return c.cast("double")
    if isinstance(data_type, T.TimestampType):
        return c.cast("double")
    local = c.cast("timestamp_ntz")
    days = F.datediff(F.to_date(local), F.lit("1970-01-01").cast("date"))
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.extract(F.lit("SECOND"), local)
    return (days.cast("double") * 86400.0) + clock.cast("double")


def pct_change(before: Column, after: Column) -> Column:
    """Percent change on the size of ``before``; null where it has no answer."""
    limit = F.lit(1.7976931348623157e308)
    finite = (F.abs(before) <= limit) & (F.abs(after) <= limit) & ~F.isnan(before) & ~F.isnan(after)
    return F.when(finite & (F.abs(before) >= 1e-12), (after - before) / F.abs(before) * 100.0)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals, zero for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def shared_marker(smallest: str, largest: str, longest_allowed: int, at_start: bool = True) -> str:
    """Longest unit-like text that all values start (or end) with.

    A prefix common to the smallest and the largest value in sort order is
    common to every value, so two aggregates decide it for a column of any
    length. For the end of the text both arguments are reversed values.
    """
    common = 0
    for left, right in zip(smallest, largest):
        if left != right:
            break
        common += 1
    for length in range(min(common, longest_allowed, MAX_MARKER_LENGTH), 0, -1):
        candidate = smallest[:length]
        if any(ch.isdigit() for ch in candidate):
            continue
        if sum(ch.isalpha() for ch in candidate) <= MAX_UNIT_LETTERS:
            return candidate if at_start else candidate[::-1]
    return ""


def undecorated_number(c: Column, prefix: str = "", suffix: str = "") -> Column:
    """Parse a number after removing the shared markers, separators and symbols."""
    text = strip_ws(c)
    if prefix:
        text = F.substring(text, len(prefix) + 1, 2**31 - 1 - len(prefix))
    if suffix:
        text = F.substring(text, F.lit(1), F.length(text) - len(suffix))
    text = F.regexp_replace(text, r"(?U)[,\s]", "")
    text = F.regexp_replace(text, r"(?U)^[^\w.\-+]+", "")
    return parse_number(F.regexp_replace(text, "%$", ""))
