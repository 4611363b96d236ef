"""Text of HTML by a state machine over the characters: quoted attributes, unclosed parts and every named reference.

``text.strip_html`` is a pass of regular expressions; this one follows the tokeniser of the HTML standard:

* a ``>`` inside a quoted attribute value does not end its tag; quotes count after ``=`` only;
* comments end at ``-->`` or ``--!>`` (``<!-->`` and ``<!--->`` are empty ones), declarations, ``<?`` and ``</`` without a name at the next ``>``;
* the content of ``script`` and ``style`` goes with them, whatever it holds;
* what is not closed (a tag, a quote, a comment, a script) reaches to the end of the text and goes;
* a ``<`` that starts none of these is text;
* references are decoded once, all names of the standard, also those that may lack their semicolon (``&copy 2020``); U+00A0 stays as it is.

Every search that fails ends the text, so the time is linear.  Null stays null, an empty text empty.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RAW = ("script", "style")  # their content is no text
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_TAG_STOP = re.compile("[>=]")
_SPACE = re.compile(r"[ \t\n\f\r]*")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _after_tag(s: str, at: int) -> int:
    """Place after the tag whose name ends at ``at``; the length of the text if it is not closed."""
    while m := _TAG_STOP.search(s, at):
        if m.group() == ">":
            return m.end()
        at = _SPACE.match(s, m.end()).end()
        if s[at : at + 1] in ('"', "'"):
            at = s.find(s[at], at + 1) + 1
            if not at:
                break
    return len(s)


def _after(s: str, mark: re.Pattern, at: int) -> int:
    m = mark.search(s, at)
    return m.end() if m else len(s)


def markup_text(s: str) -> str:
    """The text of one piece of markup."""
    out, at = [], 0
    while True:
        lt = s.find("<", at)
        while lt >= 0 and not (s[lt + 1 : lt + 2] in ("!", "?", "/") or _NAME.match(s, lt + 1)):
            lt = s.find("<", lt + 1)
        if lt >= 0 and s[lt + 1 : lt + 2] == "/" and lt + 2 == len(s):
            lt = -1  # a last "</" is text
        out.append(html.unescape(s[at : lt if lt >= 0 else len(s)]))
        if lt < 0:
            return "".join(out)
        if s.startswith("<!--", lt):
            empty = re.compile("-?>").match(s, lt + 4)
            at = empty.end() if empty else _after(s, _COMMENT_END, lt + 4)
        elif m := _NAME.match(s, lt + 1):
            at = _after_tag(s, m.end())
            if (end := _RAW_END.get(m.group().lower())) and at <= len(s):
                close = end.search(s, at)
                at = _after_tag(s, close.end()) if close else len(s)
        elif m := _NAME.match(s, lt + 2) if s[lt + 1] == "/" else None:
            at = _after_tag(s, m.end())
        else:
            at = s.find(">", lt + 1) + 1 or len(s)


@F.pandas_udf(StringType())
def _texts(values: pd.Series) -> pd.Series:
    return values.map(lambda v: markup_text(v) if isinstance(v, str) and ("<" in v or "&" in v) else v)


def strip_markup(c: Column | str) -> Column:
    """Text of a column of markup, batch by batch through Arrow."""
    return _texts(F.col(c) if isinstance(c, str) else c)
