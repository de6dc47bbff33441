"""Rule patterns are written for Python's `re.search`; Spark runs Java regexes."""

import re

_PIECE = re.compile(
    r"(?P<esc>\\.)"
    r"|(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])"
    r"|(?P<quant>\{\d+(?:,\d*)?\})"
    r"|(?P<upto>\{,(?P<most>\d+)\})"
    r"|(?P<named>\(\?P<)"
    r"|(?P<back>\(\?P=(?P<ref>\w+)\))"
    r"|(?P<brace>[{}])",
    re.S,
)


def _java_class(cls: str) -> str:
    """Inside [...] Java reads a nested `[` and `&&` as set operations: escape them."""
    head = 2 if cls.startswith("[^") else 1
    body = cls[head:-1]
    if body.startswith("]"):
        body = "\\]" + body[1:]
    body = re.sub(r"(\\.)|(\[|&)", lambda m: m[1] or "\\" + m[2], body, flags=re.S)
    return cls[:head] + body + "]"


def java_regex(pattern: str, multiline: bool = False) -> str:
    """Java spelling of a Python pattern with the same `re.search` meaning.

    (?U) gives Unicode classes, (?d) makes `$` and `.` treat only \\n as a line end.
    """

    def piece(m: re.Match) -> str:
        if m["esc"]:
            return "\\z" if m["esc"] == "\\Z" else m["esc"]
        if m["cls"]:
            return _java_class(m["cls"])
        if m["quant"]:
            return m["quant"]
        if m["upto"]:
            return "{0,%s}" % m["most"]
        if m["named"]:
            return "(?<"
        if m["back"]:
            return "\\k<%s>" % m["ref"]
        return "\\" + m["brace"]

    return ("(?Udm)" if multiline else "(?Ud)") + _PIECE.sub(piece, pattern)


def group_count(pattern: str) -> int:
    """Number of capturing groups; 1 when the local `re` cannot tell."""
    try:
        return re.compile(pattern).groups
    except re.error:
        return 1
