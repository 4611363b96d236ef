"""Text column functions.

Whitespace follows Python's ``str.split()`` / ``str.strip()`` (Unicode-wide), word characters follow
Python's Unicode ``\\w`` (letters, numbers, underscore).  Java's ``\\s``/``\\w`` are ASCII by default, so
explicit classes are used; the same class strings run unchanged in DuckDB's RE2, which is what keeps the
SQL oracle and the Spark job on one definition.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's str.split()/str.strip().
WS_CLASS = r"[\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]"
WS_RUN = WS_CLASS + "+"
# Python's Unicode \w is letters, numbers and underscore.
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_OR_WS = r"[^\p{L}\p{N}_\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]"
# Default token pattern of a scikit-learn style vectoriser: two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Abbreviation expansions applied after cleaning, in this order.
ABBREVIATIONS = (("brb", "be right back"), ("lol", "laughing out loud"))

# Named HTML character references (with a closing semicolon) by name, from Python's own table, and the two of XML that it lacks.
HTML_NAMES = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'", "nbsp": " "}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# A tag starts with a letter, a slash and a letter, or is a declaration; "5 < 10" holds none.
TAG = r"</?[A-Za-z][^>]*>|<![A-Za-z\[][^>]*>|<\?[^>]*>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Unicode-wide strip (Spark's trim removes ASCII spaces only)."""
    return F.regexp_replace(_c(c), f"^{WS_RUN}|{WS_RUN}$", "")


def merge_text(title, text, sep: str = " ", strip: bool = False) -> Column:
    """Merge title and text.

    ``strip=False`` (sep " "): ``coalesce(title,'') + sep + coalesce(text,'')`` — always has the separator.
    ``strip=True`` (sep ". "): strip both; join the non-empty ones with ``sep``; neither → "".
    """
    t, x = _c(title), _c(text)
    if not strip:
        return F.concat(F.coalesce(t, F.lit("")), F.lit(sep), F.coalesce(x, F.lit("")))
    st = F.nullif(strip_ws(t), F.lit(""))
    sx = F.nullif(strip_ws(x), F.lit(""))
    return F.concat_ws(sep, st, sx)


def word_count(c) -> Column:
    """Number of whitespace-separated words; null text counts 0."""
    parts = F.array_remove(F.split(_c(c), WS_RUN), "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("int")


def char_length(c) -> Column:
    return F.length(_c(c))


def truncate_text(c, n: int = 400) -> Column:
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def _decode(ref: Column) -> Column:
    """One character reference to its text; an unknown name or number stays as it is."""
    hexed = F.conv(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
    code = F.coalesce(F.regexp_extract(ref, "^&#([0-9]+);$", 1).try_cast("bigint"), hexed.try_cast("bigint"))
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    # UTF-32 is the code point itself in four bytes
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for kv in sorted(HTML_NAMES.items()) for x in kv])
    named = F.element_at(names, F.regexp_extract(ref, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
    return F.coalesce(F.when(F.startswith(ref, F.lit("&#")), F.when(valid, F.when(code == 160, " ").otherwise(char))).otherwise(named), ref)


def decode_references(c) -> Column:
    """Character references, named and numeric, decoded in one pass (``&amp;lt;`` gives ``&lt;``)."""
    col = _c(c)
    refs = F.transform(F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0)), _decode)
    pieces = F.arrays_zip(F.split(col, REFERENCE, -1).alias("gap"), refs.alias("ref"))
    out = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["ref"], F.lit("")))), "")
    return F.when((F.instr(col, "&") > 0) & col.rlike(REFERENCE), out).otherwise(col)


def strip_html(c) -> Column:
    """HTML → text: drop comments, script/style blocks and tags, decode character references.

    A regex pass, not a DOM parser: broken markup is not repaired, and a ``<`` that starts no tag is text.
    """
    src = _c(c)
    col = F.regexp_replace(src, r"(?s)<!--.*?-->", "")
    col = F.regexp_replace(col, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    col = F.regexp_replace(col, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    col = F.regexp_replace(col, TAG, "")
    # markup passes only run on values that contain markup at all
    return decode_references(F.when(F.instr(src, "<") > 0, col).otherwise(src))


def clean_text(c, abbreviations=ABBREVIATIONS, word_boundary: bool = False, strip=strip_html) -> Column:
    """strip HTML → drop punctuation (keep word chars and whitespace) → lower → expand abbreviations.

    Non-string / null → "".  Abbreviations are replaced as substrings by default (so "lollipop"
    changes too); ``word_boundary=True`` only replaces whole words.  ``strip`` takes the markup off;
    ``markup.strip_markup`` reads it as the HTML standard does.
    """
    col = strip(F.coalesce(_c(c), F.lit("")))
    col = F.lower(F.regexp_replace(col, NOT_WORD_OR_WS, ""))
    for abbr, full in abbreviations:
        if word_boundary:
            col = F.regexp_replace(col, rf"(?<![\p{{L}}\p{{N}}_]){abbr}(?![\p{{L}}\p{{N}}_])", full)
        else:
            col = F.replace(col, F.lit(abbr), F.lit(full))
    return col


def tokens(c) -> Column:
    """Lower-cased tokens of two or more word characters (array<string>)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN), 0)
