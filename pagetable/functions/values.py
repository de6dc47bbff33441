"""Scalar helpers: hashes, sizes, flags, rounding, timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as true.
TRUE_WORDS = ["true", "1", "t", "y", "yes", "yeah", "yup", "certainly", "uh-huh"]
# Content types handled as text (matched anywhere in the header).
TEXT_TYPES = ["text/html", "text/css", "text/csv", "text/javascript", "text/plain ", "text/xml", "application/rss+xml"]
_UNIT = {"k": 1024, "m": 1024**2, "g": 1024**3}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def content_hash(body) -> Column:
    """SHA-256 hex of a text (UTF-8) or binary body."""
    return F.sha2(_c(body).cast("binary"), 256)


def content_length(body, header=None) -> Column:
    """Content-Length header if it is a number >= 0, else characters of the body."""
    size = F.char_length(_c(body)).cast("long")
    if header is None:
        return size
    declared = _c(header).try_cast("long")
    return F.when(declared >= 0, declared).otherwise(size)


def parse_size(text) -> Column:
    """'8M' -> bytes; a negative number means unlimited (-1)."""
    t = F.lower(F.trim(_c(text)))
    number = F.regexp_extract(t, r"^(-?\d+)", 1).try_cast("long")
    unit = F.right(t, F.lit(1))
    scaled = F.when(unit == "k", number * _UNIT["k"]).when(unit == "m", number * _UNIT["m"])
    scaled = scaled.when(unit == "g", number * _UNIT["g"])
    return scaled.otherwise(F.when(number < 0, F.lit(-1)).otherwise(number))


def size_to_bytes(text) -> int:
    """Plan-time form of `parse_size` for limits given as parameters."""
    t = str(text).strip().lower()
    if t[-1] in _UNIT:
        return int(t[:-1]) * _UNIT[t[-1]]
    return max(int(t), -1)


def str_to_bool(text) -> Column:
    return F.lower(F.trim(_c(text))).isin(TRUE_WORDS)


def format_accessed(ts) -> Column:
    return F.date_format(_c(ts), "dd/MM/yyyy HH:mm:ss")


def elapsed_hms(seconds) -> Column:
    """h:mm:ss of a number of seconds, with a day part from 24 hours on."""
    s = F.floor(_c(seconds)).cast("long")
    days, rest = F.floor(s / 86400), s % 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor((rest % 3600) / 60), rest % 60)
    return (
        F.when(days == 1, F.concat(F.lit("1 day, "), clock))
        .when(days > 1, F.concat(days.cast("string"), F.lit(" days, "), clock))
        .otherwise(clock)
    )


def round_2sig(x) -> Column:
    """Two significant digits of a ratio in [0, 1], ties to even as number formatting does."""
    v = _c(x)
    return (
        F.when(v >= 0.1, F.bround(v, 2))
        .when(v >= 0.01, F.bround(v, 3))
        .when(v >= 0.001, F.bround(v, 4))
        .otherwise(F.bround(v, 5))
    )


def py_strip(text) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def remove_chars(text, entries, per_character: bool = False) -> Column:
    """Remove every entry, as a whole string or character by character."""
    out = _c(text)
    if per_character:
        letters = "".join(dict.fromkeys("".join(entries)))
        return F.translate(out, letters, "") if letters else out
    for e in entries:
        if e:
            out = F.replace(out, F.lit(e), F.lit(""))
    return out
