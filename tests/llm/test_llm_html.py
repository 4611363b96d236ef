import time

from llm_cases import prose

from starlens.llm import html_extract as H

PARA = [prose(40, i).replace(" ", ", ", 3).capitalize() + "." for i in range(6)]


def page(body, head="<title>t</title><style>p{}</style><script>var x='</p><p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_boilerplate():
    html = page(
        "<header><h1>Site</h1><p>A slogan, long enough to be scored, which is not the article.</p></header><nav><ul><li><a href=/a>Menu</a></ul></nav>"
        f"<div class='cookie-notice'><p>{PARA[5]}</p></div><article><h1>Title &amp; more</h1><p>{PARA[0]}</p><div class=ad>Buy, buy, buy this, it is a fine thing to own.</div>"
        f"<p>{PARA[1]}</p><form><p>{PARA[4]}</p></form><h2>Part</h2><ul><li>one<li>two</ul><p>{PARA[2]}<br>after</p></article>"
        f"<aside><p>{PARA[3]}</p></aside><section id=comments><p>{PARA[4]}</p></section><footer><p>{PARA[5]}</p></footer>"
    )
    assert H.extract(html).split("\n\n") == ["Title & more", PARA[0], PARA[1], "Part", "one", "two", PARA[2] + " after"]


def test_best_container_without_semantic_elements():
    links = "".join(f"<li><a href=/{i}>{prose(6, i)}</a></li>" for i in range(20))
    html = page(f"<div><ul>{links}</ul></div><div id=x><div><h2>H</h2><p>{PARA[0]}</p><p>{PARA[1]}</p><p>short</p></div><div><p>{PARA[2]}</p><p>{PARA[3]}</p></div></div><div><a href=/>{prose(20, 3)}</a></div>")
    assert H.extract(html).split("\n\n") == ["H", PARA[0], PARA[1], "short", PARA[2], PARA[3]]


def test_what_surrounds_the_best_container_is_kept():
    long, links = [", ".join([PARA[i]] * 3) for i in range(3)], "".join(f"<li><a href=/{i}>{prose(6, i)}</a></li>" for i in range(20))
    best = "<div>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    html = page(f"<div>Lead. {best}<h3>Last part</h3><div><p>Closing, short.</p></div><ul><li>one</ul><table><tr><td>cell</table>Direct <a href=/>link</a> too.<ul>{links}</ul></div>")
    assert H.extract(html).split("\n\n") == ["Lead.", *long, "Last part", "Closing, short.", "one", "cell", "Direct link too."]
    html = page(f"<div><h1>Title</h1><div><section><div><p>{long[0]}</p></div></section><section><div><p>{PARA[3]}</p></div></section></div></div><div><ul>{links}</ul><p>After.</p><a href=/>More</a></div>")
    assert H.extract(html).split("\n\n") == ["Title", long[0], PARA[3], "After."]
    assert len(H.extract("<span>" * 20000 + best + "</span>" * 20000 + "<div>end</div>").split("\n\n")) == 4


def test_layout_names_on_wrappers_do_not_cut_the_page():
    html = page(f"<div class='page with-sidebar'><div class=content><p>{PARA[0]}</p><p>{PARA[1]}</p></div><div class=sidebar><p>{PARA[2]}</p></div></div>")
    assert H.extract(html).split("\n\n") == [PARA[0], PARA[1]]


def test_a_word_of_a_longer_name_does_not_cut_the_article():
    links = "".join(f"<li><a href=/{i}>{prose(6, i)}</a></li>" for i in range(5))
    widget = "<div class='elementor-widget elementor-widget-text-editor'><p>{}</p></div>"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}"):
        for n in (2, 6):
            assert H.extract(page(wrap.format("".join(widget.format(PARA[i]) for i in range(n))))).split("\n\n") == PARA[:n]
        html = page(wrap.format(f"<p>{PARA[0]}</p><section id=related-work><p>{PARA[1]}</p></section><div class=social-impact>Short.</div><div class=header-image-caption>A caption</div><div class=my-social-list><ul>{links}</ul></div><div class=related-posts><p>{PARA[2]}</p></div><div class='box ad'><p>{PARA[3]}</p></div><pre><span class=hljs-comment># code</span> x</pre>"))
        assert H.extract(html).split("\n\n") == [PARA[0], PARA[1], "Short.", "A caption", "# code x"]


def test_long_parts_beside_the_article_are_cut_by_their_name():
    for name in ("sidebar", "advert", "comment-list"):
        html = page(f"<div><div class='{name}'>" + "".join(f"<p>{x}</p>" for x in PARA[1:]) + f"</div><div><p>{PARA[0]}</p></div></div>")
        assert H.extract(html) == PARA[0]
        assert H.extract(page(f"<div class='{name}'><p>{PARA[0]}</p></div>")) == PARA[0]
    assert H.extract(page(f"<div><p>{PARA[0]}</p><p>{PARA[1]}</p></div><div class=acme-footer><p>{PARA[2]}</p></div>")).split("\n\n") == PARA[:2]
    assert H.extract("<div class=x-widget>" * 20000 + "<p class=x-widget>deep" * 20000).count("deep") == 20000
    assert H.extract("<div class=sidebar>" * 20000 + PARA[0]) == PARA[0]


def test_clear_names_within_the_article_are_cut():
    names = "sponsored-content advert-wide site-notice notice-box user-comments-wrap2 reader-comment promo-card cookie-message newsletter-form2 share-tools related-stories-wide comment-body ad-unit"
    for name in names.split():
        assert H.extract(page(f"<article><p>{PARA[0]}</p><div class='{name}'><p>{PARA[1]}</p></div><p>{PARA[2]}</p></article>")).split("\n\n") == [PARA[0], PARA[2]], name
    for name in ("elementor-widget", "related-work", "social-impact", "header-image-caption", "no-sidebar", "with-comments"):
        assert H.extract(page(f"<article><p>{PARA[0]}</p><div class='{name}'><p>{PARA[1]}</p></div><p>{PARA[2]}</p></article>")).split("\n\n") == PARA[:3], name


def test_stray_tags_take_linear_time():
    began = time.process_time()
    assert H.extract("<i>" * 100_000 + "</b>" * 100_000 + PARA[0]) == PARA[0]
    assert H.extract("<div>" * 50_000 + "<li>x" * 50_000).count("x") == 50_000
    assert H.extract("text" + "<a href='" * 100_000) == "text"
    assert time.process_time() - began < 30


def test_formulas_and_xmp():
    html = page(f"<article><p>{PARA[0]} <math><semantics><mi>x</mi><mo>&lt;</mo><mn>2</mn><annotation>x \\lt 2</annotation></semantics></math> holds</p><xmp>a <b> &amp; c</xmp><p>end</article>")
    assert H.extract(html).split("\n\n") == [PARA[0] + " x<2 holds", "a <b> &amp; c", "end"]


def test_broken_markup():
    assert H.extract(None) == "" and H.extract("") == "" and H.extract("plain  text\n only") == "plain text only"
    assert H.extract("<p>unclosed <b>bold <p>two") == "unclosed bold\n\ntwo"
    assert H.extract("<div>a<!-- never ends <p>b") == "a"
    assert H.extract("<p a=\"x>y\">t</p>") == "t"
    assert H.extract("<p>a &lt; b &amp;&#8212; c &nbsp; d < e</p>") == "a < b &— c d < e"
    assert H.extract("<p>cut off</p><a href=\"x") == "cut off"
    assert H.extract("<script>never ends") == ""
    assert H.extract("</div></p>text<br/>more") == "text more"
    assert H.extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert len(H.extract("<p>" + "word, " * 100000)) == 599999


def test_pages(spark):
    rows = [(1, "u", page(f"<article><p>{PARA[0]}</p></article>"), 5), (1, "u", None, 5), (None, None, "", 5), (2, "v", "<p>x</p>", 6), (2, "v", "<p>x</p>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert got == sorted([("1", "u", PARA[0], len(PARA[0])), ("1", "u", "", 0), ("None", "None", "", 0), ("2", "v", "x", 1), ("2", "v", "x", 1)])
    assert H.extract_pages(df.limit(0)).collect() == []
