"""Column helpers for dirty identifiers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is dropped around identifiers.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                　"


def filled(c: Column) -> Column:
    """The text, null where it is empty. Unlike ``nullif`` it leaves a scan free to read only the nested fields in use."""
    return F.when(c != "", c)


def user_key(c: Column) -> Column:
    """User id in lower case without surrounding white space; null where nothing is left."""
    return filled(F.lower(F.btrim(c, F.lit(BLANKS))))


def type_key(c: Column) -> Column:
    """One spelling per event type: ``CreatePost``, ``create-post`` and ``CREATE_POST `` all become ``create_post``; null where nothing is left."""
    t = F.btrim(c, F.lit(BLANKS))
    snake = F.lower(F.regexp_replace(F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-.]+", "_"))
    return filled(F.when(t.rlike(r"^[a-z0-9_]*$"), t).otherwise(snake))


def whole_number_key(c: Column) -> Column:
    """Digits of a whole number, however written (``12``, ``+12``, ``" 12 "``, ``"12"``, ``12.0``); null for null, empty, 0 and other text."""
    body = F.btrim(c, F.lit(BLANKS + "\"'"))
    plain = F.when(body.rlike(r"^[1-9][0-9]*$"), body).otherwise(
        F.nullif(F.regexp_extract(body, r"^([+-]?)0*([0-9]*?)(?:\.0*)?$", 2), F.lit(""))
    )
    sign = F.when(body.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(plain.isNotNull() & (F.regexp_replace(plain, "0", "") != ""), F.concat(sign, plain))


def send_time_us(c: Column) -> Column:
    """Microseconds since 1970 of a time written as text; null where unreadable.

    Takes ISO forms (``T``, ``t`` or a space, any fraction, ``Z`` or an offset; no zone means UTC) and whole numbers
    of seconds, milliseconds, microseconds or nanoseconds by their length. Digits finer than a microsecond are cut off.
    """
    s = F.upper(F.btrim(c, F.lit(BLANKS)))
    n = F.length(s)
    sign = lambda at: F.substring(s, at, 1).isin("+", "-")
    zoned = F.substring(s, -1, 1).eqNullSafe("Z") | sign(-6) | sign(-5) | sign(-3)
    iso = F.when(n <= 10, F.concat(s, F.lit("T00:00:00Z"))).when(zoned, s).otherwise(F.concat(s, F.lit("Z")))
    whole = F.when(s.rlike(r"^[0-9]{9,19}$"), s.try_cast("bigint"))
    number = F.when(n <= 10, whole * 1_000_000).when(n <= 13, whole * 1000).when(n <= 16, whole).otherwise(F.floor(whole / F.lit(1000)).cast("bigint"))
    return F.when(F.substring(s, 5, 1) == "-", F.when(n >= 8, F.unix_micros(iso.try_cast("timestamp")))).otherwise(number)


def ntz_us(c: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column read as UTC, whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def us_ntz(c: Column) -> Column:
    """TIMESTAMP_NTZ in UTC of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def readable_object(c: Column) -> Column:
    """True where the text is one whole JSON object. Spark's own parser lets text behind the object pass, so brackets outside strings must also balance."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\\.", ""), r'"[^"]*"', "")
    none = F.lit("")
    left, right = (F.length(F.replace(F.replace(bare, F.lit(a), none), F.lit(b), none)) for a, b in ("{[", "}]"))
    whole = F.btrim(bare, F.lit(BLANKS))
    return F.coalesce(F.call_function("try_parse_json", c).isNotNull() & whole.startswith("{") & whole.endswith("}") & (left == right) & ~bare.rlike(r"[}\]]\s*[{\[]"), F.lit(False))
