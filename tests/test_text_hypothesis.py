"""Random Unicode strings: Spark text functions agree with Python's own str / re semantics (N6–N8)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from starlens.functions import text as T

# whitespace of every kind, letters/digits of several scripts, punctuation, underscores, markup-free
ALPHABET = st.sampled_from(
    list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　") + list("aZé9_ßжド٣!?.,'-\"") + ["É", "́"]
)
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=20, max_size=60)


def py_clean(s):
    s = re.sub(r"[^\w\s]", "", s)
    s = s.lower()
    for a, b in T.ABBREVIATIONS:
        s = s.replace(a, b)
    return s


@settings(max_examples=6, deadline=None)
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", T.word_count("t").alias("wc"), T.strip_ws("t").alias("st"), T.clean_text("t").alias("cl"),
        T.merge_text("t", "t", ". ", strip=True).alias("mg"),
    ).collect()
    for r in rows:
        s = texts[r["i"]]
        assert r["wc"] == len(s.split()), repr(s)
        assert r["st"] == s.strip(), repr(s)
        assert r["cl"] == py_clean(s), repr(s)
        exp = ". ".join(p for p in (s.strip(), s.strip()) if p)
        assert r["mg"] == exp, repr(s)
