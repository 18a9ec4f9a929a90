"""Scalar functions: identities, severities, rates, windows on integer time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """sha256 of the parts joined by a vertical bar; a missing part is a zero byte, so that it is told from an empty and from none."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\0")) for p in parts)), 256)


def rate(n: Column, of: Column) -> Column:
    """A share, 0.0 on an empty whole."""
    return F.coalesce(F.try_divide(n, of), F.lit(0.0))


def window_start(ts_us: Column, seconds: int) -> Column:
    """Start of the tumbling window [start, start + seconds), in microseconds of integer time."""
    size = seconds * 1_000_000
    return F.floor(ts_us / F.lit(size)).cast("long") * F.lit(size)


#: Fixed severity groups by number: 1-4, 5-8, ... 21-24; anything else is UNSPECIFIED.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def severity_group(number: Column) -> Column:
    found = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.floor((number - 1) / 4) + 1).cast("int"))
    return F.when(number.between(1, 24), found).otherwise("UNSPECIFIED")


def terms(text: Column) -> Column:
    """Lower-cased search terms: words of letters and digits, whose inner dots, dashes and underscores join compounds; a compound
    is followed by its parts."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+(?:[._-][a-z0-9]+)*"), F.lit(0))
    with_parts = lambda w: F.when(F.regexp_like(w, F.lit("[._-]")), F.concat(F.array(w), F.split(w, "[._-]"))).otherwise(F.array(w))
    # most texts have no compound, and need no look at each word
    return F.when(F.regexp_like(low, F.lit("[a-z0-9][._-][a-z0-9]")), F.flatten(F.transform(words, with_parts))).otherwise(words)


def normal_text(text: Column) -> Column:
    """Line ends as \\n, no blanks before them, white space at the end as one \\n. The front and blank lines stay."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit("\n"))


def fixed(value: Column, digits: int = 6) -> Column:
    """Rounded half up by multiplication, which any engine of IEEE numbers repeats bit for bit."""
    return F.floor(value * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def mean_of_largest(values: Column, k: int) -> Column:
    """Mean of the k largest entries of an array."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
