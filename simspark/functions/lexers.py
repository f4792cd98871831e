"""Lexers of the C family as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simspark.sources.lines import LEXEMES, NO_CALLS


def strip_comments(code: Column, every_line: bool = True) -> Column:
    """Without comments; line comments on every line, or only on the last one, as in the published tokens."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"(?m)//.*$" if every_line else r"//.*\z", "")


def lexemes(code: Column, lang: str = "c", every_line: bool = True) -> Column:
    """Names, numbers as <NUM> and operators, in order."""
    found = F.regexp_extract_all(strip_comments(code, every_line), F.lit(LEXEMES[lang]), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), "<NUM>").otherwise(t))


def calls(line: Column, lang: str = "c") -> Column:
    """Names called on a line; line comments, strings and characters are masked first."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"//.*$", ""), r'"(?:[^"\\]|\\.)*"', '"STR"'), r"'(?:[^'\\]|\\.)*'", "'CHR'")
    names = F.regexp_extract_all(masked, F.lit(r"\b([A-Za-z_][A-Za-z0-9_" + ("." if lang == "java" else "") + r"]*)\s*\("), F.lit(1))
    return F.filter(names, lambda x: ~x.isin(*NO_CALLS[lang]))
