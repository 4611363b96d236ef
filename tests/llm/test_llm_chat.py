import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starlens.llm import chat_template as C

RENDER = C.compile_template(C.TEMPLATE)
TEXT = st.text(alphabet=st.sampled_from("#\\<>/turn :\na é𝄞") | st.characters(codec="utf-8"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a: b", "### x"]) | TEXT, TEXT | st.just(C.PLANTED)), max_size=5))
def test_round_trip(turns):
    text, spans = RENDER([{"role": r, "text": t} for r, t in turns])
    assert C.read_back(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("</turn>") == len(turns)


def test_language():
    msgs = [{"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}]
    run = lambda t: C.compile_template(t)(msgs)[0]
    assert run("{% for m in messages %}{{ loop.index }}/{{ loop.length }}:{{ m['text'] | trim | upper }}{% if not loop.last %},{% endif %}{% endfor %}") == "1/2:HI,2/2:YO"
    assert run("{% if messages[0].role == 'user' and 1 < 2 %}a{% elif true %}b{% else %}c{% endif %}") == "a"
    assert run("{% set x = 'a' ~ 1 + 2 %}{{ x }}{{ none }}{{ nothing.at.all }}") == "a12"
    assert run("a  {%- if true -%}  b  {%- endif %} c{# note #}") == "ab c"
    assert run("{{ 'x\\n' + \"y\" }}{{ (1 + 2) }}{{ messages | length }}") == "x\ny32"
    assert C.compile_template("a{% generation %}b{% endgeneration %}c{% generation %}{% endgeneration %}")([])[1] == [(1, 2), (3, 3)]


def test_constants_fold():
    tree = C.fold(C.parse_template("a{{ 'b' ~ 'c' | upper }}{% if 1 == 1 %}d{{ 1 + 2 }}{% else %}e{% endif %}{% if false %}f{% endif %}"))
    assert tree == (C.Output(C.Const("abCd3")),)


@pytest.mark.parametrize("bad", ["{% for %}", "{{ 1 + }}", "{% if x %}", "{{ x | evil }}", "{{ f(1) }}", "{% import os %}", "{{ a b }}", "{{ 'x }}", "{% endfor %}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_sandbox_reaches_no_attributes():
    assert C.compile_template("{{ messages.__class__ }}{{ messages[0].__init__ }}{{ messages.append }}")([{"role": "u"}])[0] == ""


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b ### c"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, None, "user", "y" * 100000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, CONV string, turns int")
    got = {r.conv_id: r for r in C.digest_conversations(C.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    turns = {1: [("user", ""), ("assistant", "a"), ("assistant", "b ### c")], 2: [("", "x")] * 2, None: [("assistant", "")], 3: [("user", "y" * 100000)]}
    assert set(got) == set(turns)
    for k, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))
    assert C.digest_conversations(C.format_conversations(df.limit(0))).collect() == []
