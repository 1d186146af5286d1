import time

import pytest

from govlens.llm import extract

LONG = "This is prose, long enough to count, with a comma or two, and more."
PAGES = {
    "blocks": (f"<article><h1>Title</h1><p>{LONG}<p>Se&ccedil;ond<br>line &lt;x&gt;\n\t z</article>", f"Title\n\n{LONG}\n\nSeçond line <x> z"),
    "cut": (
        f"<body><header>Site</header><nav><a>menu</a></nav><div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p>"
        f"<form><p>{LONG}</p></form><aside>{LONG}</aside><div id=comments><p>{LONG}</p></div></main><footer>{LONG}</footer>",
        LONG,
    ),
    "scripts": (f"<title>t</title><script>'<p>{LONG}</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p>", LONG),
    "siblings": (f"<div><div class=s1><p>{LONG}</p><p>{LONG}</p></div><div class=s2><p>{LONG}</p></div></div>", "\n\n".join([LONG] * 3)),
    "links": (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", LONG),
    "list": (f"<article><p>{LONG}</p><ul><li>one<li>two<li>three</ul></article>", f"{LONG}\n\none\n\ntwo\n\nthree"),
    "hidden": (f"<p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>{LONG}</p>", LONG),
    "unclosed": ("<article><p><b>Only.<br></article><footer>f</footer>", "Only."),
    "plain": ("just text &amp; more", "just text & more"),
    "nested header": (f"<article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n\n{LONG}"),
    "empty": ("", ""),
    "null": (None, ""),
    "broken": ("<p", ""),
    "no text": ("<html><body><nav>x</nav></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    source, want = PAGES[name]
    assert extract.main_text(source or "") == want


@pytest.mark.parametrize(
    "wrapper",
    ["div class=has-sidebar", "main class=no-sidebar", "div id=hasSidebar", "article class='article-with-comments'",
     "div class=search-result", "div class=share-enabled", "article class=promo", "div class='post modal-open'",
     "span class=widget", "div class=masthead"],
)
def test_marks_of_a_wrapper_do_not_cut_the_article(wrapper):
    tag = wrapper.split()[0]
    page = (
        f"<body><p>{LONG}</p><{wrapper}><p>{LONG} one</p><div class=sidebar><p>{LONG} no</p></div>"
        f"<p>{LONG} two</p><p>{LONG} three</p></{tag}>"
    )
    text = extract.main_text(page)
    assert all(f"{LONG} {w}" in text for w in ("one", "two", "three")) and "no" not in text.split()


def test_many_comments_are_no_article():
    comment = f"<article class=comment id=c1><p>{LONG} no</p></article>"
    for area in ("div class=comments-area", "section id=comments", "div class='comment-content'"):
        page = f"<article><p>{LONG} yes</p></article><{area}>{comment * 5}</{area.split()[0]}>"
        assert extract.main_text(page) == f"{LONG} yes"


@pytest.mark.parametrize(
    "part",
    ["p class='social-history'", "p class='related-work'", "h2 id='search-methods'", "h2 id='notice-periods'",
     "section id='comments-on-method'"],
)
@pytest.mark.parametrize("around", ["article", "div class=wrap", "main"])
def test_a_mark_in_a_name_does_not_cut_a_part_of_the_article(part, around):
    inner = f"<{part}>{LONG} kept</{part.split()[0]}><div class='ad-slot'><p>{LONG} no</p></div><p class=promo>{LONG} no</p>"
    page = f"<body><{around}><p>{LONG} one</p>{inner}<p>{LONG} two</p><p>{LONG} three</p></{around.split()[0]}></body>"
    assert extract.main_text(page) == "\n\n".join(f"{LONG} {w}" for w in ("one", "kept", "two", "three"))


def test_boxes_beside_the_article_go_by_one_mark():
    box = f"<div class='related-work'><p>{LONG} no</p></div>"
    for around in ("article", "div"):
        page = f"<body>{box}<{around}><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></{around}>{box}</body>"
        assert extract.main_text(page) == "\n\n".join([LONG] * 3)


def test_a_short_article_outweighs_an_advert():
    advert = f"<div class=ad>{LONG}</div>"
    assert extract.main_text(f"<body>{advert}<article><h1>Few.</h1><p>Words.</p></article></body>") == "Few.\n\nWords."


def test_parts_beside_the_container_stay():
    body = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    assert extract.main_text(f"<body><div>{body}<div><p>short</p></div></div>") == f"{LONG}\n\n{LONG}\n\nshort"
    assert extract.main_text(f"<body><div><div><h1>Title</h1></div>{body}</div>") == f"Title\n\n{LONG}\n\n{LONG}"
    assert extract.main_text(f"<body><div><h1>Title</h1></div><div><div>{body}</div></div>") == f"Title\n\n{LONG}\n\n{LONG}"
    columns = "".join(f"<div class=col><div><p>{LONG} {k}</p></div></div>" for k in range(2))
    assert extract.main_text(f"<body><div>{columns}</div>") == f"{LONG} 0\n\n{LONG} 1"
    table = "<div><table><tr><td>x<td>y</table></div>"
    assert extract.main_text(f"<body><div>{body}{table}{body}</div>") == "\n\n".join([LONG, LONG, "x", "y", LONG, LONG])


def test_stray_end_tags_are_linear():
    begin = time.perf_counter()
    assert extract.main_text("<span>" * 100_000 + "</b>" * 100_000 + "x") == "x"
    assert time.perf_counter() - begin < 10


def test_hostile_markup_is_linear():
    assert extract.main_text("<div " * 50_000 + "<p>x") == "x"
    assert extract.main_text("<b>" * 20_000 + "deep") == "deep"
    assert extract.main_text('<a title="' * 20_000).strip() == ""


def test_report(spark):
    rows = [(k, f"u{k}", s, "old") for k, (s, _) in enumerate(PAGES.values())] + [(0, "u0", PAGES["blocks"][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract.report(df).collect()
    want = [(k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES.values())]
    want.append((0, "u0", want[0][2], want[0][3]))
    assert sorted(map(tuple, out)) == sorted(want)
    assert extract.report(df.limit(0)).count() == 0
