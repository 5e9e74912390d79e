"""Unicode forms, which have no built-in: Arrow-batched functions, everything else stays native."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters without a width, and Hebrew and Arabic presentation forms
INVISIBLE = "[​-‏‪-‮⁠-⁤﻿­]"
PRESENTATION = "[יִ-ﭏﭐ-﷿ﹰ-ﻼ]+"


@F.pandas_udf("string")
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf("string")
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf("string")
def nfc_folding_forms(text: pd.Series) -> pd.Series:
    """NFC, and NFKC on presentation forms alone, so that superscripts survive."""
    import re

    forms = re.compile(PRESENTATION)
    return text.map(lambda t: unicodedata.normalize("NFC", forms.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)), na_action="ignore")


def _tidy(text: Column, trim: bool) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), "[\t ]", " "), " {2,}", " ")
    return F.trim(out) if trim else out


def page_text(text: Column) -> Column:
    """NFKC, no invisible characters, single blanks, trimmed."""
    return _tidy(nfkc(F.regexp_replace(text, "\r", "\n")), True)


def line_text(text: Column) -> Column:
    """NFC with folded presentation forms, no invisible characters, single blanks, trimmed."""
    return _tidy(nfc_folding_forms(text), True)


def run_text(text: Column) -> Column:
    """The same for a piece of a line: blanks at its edges stay."""
    return _tidy(nfc_folding_forms(text), False)
