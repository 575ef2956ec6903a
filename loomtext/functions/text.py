"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks that normalisation folds; the ideographic space is not among them.
FOLDED = r"[ \t\r\n\f\x0B   ]+"


def fold_blanks(t: Column) -> Column:
    """Runs of blanks as one space; Unicode white space is stripped at the ends."""
    return F.regexp_replace(F.regexp_replace(t, FOLDED, " "), r"(?U)^\s+|(?U)\s+$", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize(t: Column) -> Column:
    """NFC, then fold_blanks; texts that are ASCII are in NFC already and skip Python's part in the caller's filter."""
    return fold_blanks(nfc(t))


def sentences_de(t: Column, rules: bool = True) -> Column:
    """Split behind a stop and an optional closing guillemet; with rules, not before a lower-case letter or a dash."""
    ahead = r"(?=[^\s\p{Ll}-])" if rules else r"(?=\S)"
    return F.split(t, rf"(?<=[.!?]|[.!?]«)\s+{ahead}")


def sentences_en(t: Column, rules: bool = True) -> Column:
    """Split behind stops and an optional closing quote, never before a lower-case letter; with rules, not behind Mr. or Mrs."""
    behind = r"(?<!Mr\.)(?<!Mrs\.)" if rules else ""
    return F.split(t, rf"(?<=[.!?]|[.!?][”’]){behind}\s+(?=[^\s\p{{Ll}}])")


def sentences_ja(t: Column, rules: bool = True) -> Column:
    """Split behind a full stop; behind a full-width ! or ? unless a closing bracket follows; behind a closing bracket
    unless (with rules) a particle that carries the quotation on follows. Never at the end."""
    bracket = r"(?!と|など)" if rules else ""
    parts = F.split(t, rf"(?<=。)(?!$)|(?<=[！？])(?![」]|$)|(?<=」){bracket}(?!$)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|(?U)\s+$", "")), lambda x: x != "")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+|[^\w\s]"), 0)


def strip_markup(html: Column) -> Column:
    """Ruby keeps its base text, other tags go, blanks are folded."""
    base = F.regexp_replace(html, r"(?s)<ruby>\s*<rb>(.*?)</rb>.*?</ruby>", "$1")
    return fold_blanks(F.regexp_replace(base, r"(?s)<[^>]*>", ""))


def term_pattern(term: str, whole: bool) -> str:
    """A term as a word, or as the beginning of one."""
    return rf"(?U)\b\Q{term}\E\b" if whole else rf"(?U)\b\Q{term}\E\w*"


def glob_regex(glob: str) -> str:
    """A shell pattern (* and ?) as a regular expression for the whole string."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else rf"\Q{c}\E" for c in glob) + "$"


def strip_ansi(t: Column) -> Column:
    """A terminal's output without its colour and cursor sequences."""
    return F.regexp_replace(t, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")


def percent(x: Column, digits: int = 1) -> Column:
    """0.1234 as 12.3%."""
    return F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))


def thousands(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def iso_time(t: Column, zone: str = "+09:00") -> Column:
    """A moment as ISO 8601 to the second at a fixed offset from UTC. The session's time zone has to be UTC."""
    return F.concat(F.date_format(F.from_utc_timestamp(t, zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
