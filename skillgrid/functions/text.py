"""Column -> Column text operators (inventory N1-N3, N5, N16-N23, N31, N35).

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen and need no Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character class that plays the role of Python's Unicode ``\w``.  Written out
# so that the same pattern means the same thing in Java regex and in RE2.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_whitespace(c) -> Column:
    """Every newline, carriage return and tab becomes one space; then trim."""
    return F.trim(F.translate(_col(c), "\n\r\t", "   "))


def blank_to_null(c) -> Column:
    """``NULLIF(TRIM(x), '')``."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def prereq_clean(c) -> Column:
    """``NOT FOUND`` / ``NONE`` / empty (after removing dots, any case) -> NULL."""
    c = _col(c)
    marker = F.upper(F.regexp_replace(c, r"\.", ""))
    return F.nullif(F.trim(F.when(marker.isin("NOT FOUND", "NONE", ""), F.lit(None)).otherwise(c)), F.lit(""))


def strip_not_found(c) -> Column:
    """Remove the literal ``Not found``; an empty result becomes NULL."""
    return F.nullif(F.replace(_col(c), F.lit("Not found"), F.lit("")), F.lit(""))


def list_string_clean(c) -> Column:
    """Drop ``[``, ``]`` and ``'`` from a Python-list-looking string."""
    return F.translate(_col(c), "[]'", "")


def split_rejoin(c, delimiter: str = ",") -> Column:
    """Split on a delimiter and re-join with ``", "``.

    Elements are not trimmed, so ``a, b`` becomes ``a,  b`` exactly like the
    warehouse's SPLIT/ARRAY_TO_STRING pair.
    """
    return F.array_join(F.split(F.trim(_col(c)), _regex_literal(delimiter)), ", ")


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$|?*+()[]{}\\" else ch for ch in s)


def url_prefix(c, host: str) -> Column:
    """Prefix ``host`` to relative paths only, so applying it twice is harmless."""
    c = _col(c)
    return F.when(c.startswith("/"), F.concat(F.lit(host.rstrip("/")), c)).otherwise(c)


def url_strip_query(c) -> Column:
    """Drop a ``?query`` suffix."""
    return F.regexp_replace(_col(c), r"\?.*", "")


def strip_py(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


# ---- N23 PII scrub -------------------------------------------------------
# Fixed patterns, applied in this order (the reference's resume cleaner):
#   1. e-mail:  \S+@\S+
#   2. phone:   \(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}
#   3. address: \d{1,5}\s\w+(\s\w+)*,\s?\w+\s?\w*
#   4. keep only  a-z A-Z 0-9 . , ! ? ; : ' - and whitespace
#   5. collapse whitespace runs to one space, strip
# ``\w`` is spelled as the Unicode word class so the Java and RE2 readings agree.
PII_PATTERNS = (
    r"\S+@\S+",
    r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    r"[0-9]{1,5}\s" + WORD + r"+(\s" + WORD + r"+)*,\s?" + WORD + r"+\s?" + WORD + r"*",
    r"[^a-zA-Z0-9.,!?;:'\-\s]",
)


def pii_scrub(c) -> Column:
    """Five ordered removals; order matters (the address rule sees phone-free text).

    Two exact speed-ups: the e-mail rule only runs on texts containing ``@``
    (it cannot match otherwise), and disallowed characters are removed in runs
    (``[...]+``) instead of one match per character -- same result.
    """
    email, phone, address, disallowed = PII_PATTERNS
    out = _col(c)
    out = F.when(F.instr(out, "@") > 0, F.regexp_replace(out, email, "")).otherwise(out)
    out = F.regexp_replace(out, phone, "")
    out = F.regexp_replace(out, address, "")
    out = F.regexp_replace(out, disallowed + "+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_case_source(c) -> Column:
    """N31 (first half): ``learning_path`` -> ``Learning Path``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def timestamp_display(c) -> Column:
    """N31 (second half): ISO timestamp text cut to 19 characters, ``T`` -> space."""
    return F.replace(F.substring(_col(c), 1, 19), F.lit("T"), F.lit(" "))


def nullable_concat_doc(cols, strict: bool = True, sep: str = " ") -> Column:
    """One text from many columns; strict mode is NULL when any input is."""
    cols = [_col(c) for c in cols]
    if strict:
        parts = []
        for i, c in enumerate(cols):
            if i:
                parts.append(F.lit(sep))
            parts.append(c)
        return F.concat(*parts)
    return F.concat_ws(sep, *cols)
