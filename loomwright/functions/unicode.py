"""Arrow functions for what needs Unicode tables: NFKC and what builds on it."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import cleaned


#: Characters that NFKC leaves alone wherever they stand: up to U+009F, and composed Latin letters, those of Vietnamese among them.
STABLE = r"\x{0}-\x{9f}\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{1ea0}-\x{1ef9}"


@F.pandas_udf(T.StringType())
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column | str) -> Column:
    """NFKC normalization; null stays null. Texts of stable characters alone stay in the JVM: Python gets nulls in their place."""
    text = F.col(text) if isinstance(text, str) else text
    changes = F.regexp_like(text, F.lit(f"[^{STABLE}]"))
    return F.coalesce(_normalized(F.when(changes, text)), text)


def clean_text(text: Column, space_cjk: bool = False, replace_newline: bool = False) -> Column:
    return cleaned(nfkc(text), replace_newline, space_cjk)


def category(prefix: str) -> list[str]:
    """All characters whose Unicode category starts with `prefix`: the tables of Cc, Cf, Zl, Zp and Zs by rule."""
    return [c for c in map(chr, range(0x110000)) if unicodedata.category(c).startswith(prefix)]
