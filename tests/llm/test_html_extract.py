import pytest

from codestrata.llm import html_extract as he

BODY = "This is the story, told in some sentences. It goes on for a while, as stories do."


def main_text(page):
    found = list(he.blocks(page))
    return he.text_under(found, he.best(he.scores(found)))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body><nav><a href=x>Menu</a></nav><article><h1>T&amp;T</h1><p>{BODY}</article><footer>&copy; f</footer>", f"T&T {BODY}"),
        (f"<div class='post-12 x'><p>{BODY}<p>a  b\n c<br>d</p>tail</div><div class='side-bar ad'>{BODY}</div>", f"{BODY} a b c d tail"),
        (f"<article><header><h1>Head</h1></header>{BODY}<aside>{BODY}</aside><section id=comments>{BODY}</section></article>", f"Head {BODY}"),
        (f"<body><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>x --><p>{BODY} 1 < 2 &am x &lt;b&gt;</p><form>{BODY}</form></body>", f"{BODY} 1 < 2 &am x <b>"),
        (f"<article><ul><li>one, two<li>three</ul><table><tr><td>{BODY}<td>{BODY}</table></article>", f"one, two three {BODY} {BODY}"),
        (f"<div class=cookie-notice>{BODY}</div><main><div class=reader-comments>{BODY}</div><p>{BODY}</main>", BODY),
        (f"<p>{BODY} <b>bo<i>ld</b> it</i> end <a href=\"a>b\">link</a>", f"{BODY} bold it end link"),
        ("", ""), ("<nav>only menu</nav>", ""), ("plain text, no tags", "plain text, no tags"), ("<", "<"), ("<p", ""), ("<!--", ""), ("a<br", "a"), ("&#65;&nbsp;&#x42;", "A\xa0B"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, _path string")


def test_the_host_s_path_wins_over_a_page_s_own(spark):
    long_list = "<div class=teaser-{}><p>" + ", ".join(["Another story"] * 40) + ".</p></div>"
    usual = "<body><div class=story-{}><p>" + BODY * 4 + "</p></div></body>"
    odd_one = "<body><div class=story-9><p>" + BODY + "</p></div>" + long_list.format(3) + "</body>"
    rows = [(k, f"https://u@News.Example.com:80/{k}", usual.format(k)) for k in range(5)] + [(9, "http://news.example.com/9", odd_one)]
    rows += [(10, "http://elsewhere.org/", odd_one), (11, None, odd_one), (11, "no url", odd_one), (12, "http://news.example.com", "<p>" + BODY)]
    got = he.extract_pages(pages(spark, *rows))
    assert got.columns == ["page_id", "url", "text"]
    texts = sorted((r.page_id, r.text) for r in got.collect())
    teaser = ", ".join(["Another story"] * 40) + "."
    assert texts == sorted([(k, BODY * 4) for k in range(5)] + [(9, BODY), (10, teaser), (11, teaser), (11, teaser), (12, BODY)])


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "", ""), (2, "http://a/", None), (2, "http://a/", None), (3, "http://a/", "<div>" * 3000 + BODY), (4, "http://a/", "x " * 300_000)]
    got = sorted((str(r.page_id), r.text) for r in he.extract_pages(pages(spark, *rows)).collect())
    assert got == sorted([("None", ""), ("1", ""), ("2", ""), ("2", ""), ("3", BODY), ("4", ("x " * 300_000).strip())])
    assert he.extract_pages(pages(spark).limit(0)).count() == 0


ABOUT_IT = "Some words come first, to say what it is about. They are fewer than the rest."
LAST = "At the end a few words are left to say. Then the story is over."


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div class='content has-sidebar'>", "</div>"), ("<div id=page class='no-comments'>", "</div>"), ("<div class='layout-with-nav'>", "</div>"), ("<form action=/>", "</form>"),
        ("<div class=widget><article>", "</article></div>"), ("<form><main>", "</main></form>"), ("<div class=page-widget><div class=post>", "</div></div>"), ("<my-page class=promo>", "</my-page>"),
        ("<div class=post><section class='related-work'>", "</section></div>"),
    ],
)
def test_a_name_does_not_drop_what_holds_the_text(spark, before, after):
    page = f"<html><body><nav><a href=x>Menu</a></nav>{before}<p>{BODY}</p><div class=ad>{LAST}</div><p>{BODY}</p>{after}<div class=comments>{LAST}</div></body></html>"
    rows = [(k, url, page) for k, url in enumerate(["http://a/1", "http://a/2", None])]
    assert [r.text for r in he.extract_pages(pages(spark, *rows)).collect()] == [f"{BODY} {BODY}"] * 3


@pytest.mark.parametrize(
    "inside, want",
    [
        (f"<section class=intro><p>{ABOUT_IT}</p></section><section class=body><p>{BODY * 3}</p></section><section class=end><p>{LAST}</p></section>", f"{ABOUT_IT} {BODY * 3} {LAST}"),
        (f"<h1>Head</h1><p>{ABOUT_IT}</p><blockquote><p>{BODY * 6}</p></blockquote><p>{LAST}</p>", f"Head {ABOUT_IT} {BODY * 6} {LAST}"),
        (f"<div class=a><div class=b><p>{BODY * 5}</p></div><div class=c><a href=x>{LAST}</a></div><div class=comments>{LAST}</div></div><div class=d>{LAST}</div>", f"{BODY * 5} {LAST}"),
        (f"<table><tr><td class=x>{BODY * 5}<td class=y>{LAST}</table><div class=links><a href=x>One. Two. Three.</a></div>", f"{BODY * 5} {LAST}"),
    ],
)
def test_parts_beside_the_best_container_are_kept(spark, inside, want):
    page = f"<body><nav>Menu, and so on and so on.</nav><div class=post>{inside}</div><footer>{LAST}</footer></body>"
    rows = [(k, url, page) for k, url in enumerate(["http://a/1", "http://a/2", None])]
    assert [r.text for r in he.extract_pages(pages(spark, *rows)).collect()] == [want] * 3


def test_comments_longer_than_the_text_do_not_win_the_host(spark):
    page = "<body><div class=post><p>{}</p></div><div id=comments><p>{}</p></div></body>"
    rows = [(k, f"http://a/{k}", page.format(BODY, LAST * (9 if k == 2 else 1))) for k in range(3)]
    assert [r.text for r in he.extract_pages(pages(spark, *rows)).collect()] == [BODY] * 3


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p title=Bob's>One sentence here.</p><p>Two don't stop.</p></article>", "One sentence here. Two don't stop."),
        ('<article><img alt="5" tall"><p>One sentence here, "quoted".</p></article>', 'One sentence here, "quoted".'),
        ("<article><p title=Bob's>No later apostrophe.</p></article>", "No later apostrophe."),
        ('<article><p title="a > b" data-x = \'<p class="ad">\'>Kept, all of it.</p><a href=x class=>and</a> this.</article>', "Kept, all of it. and this."),
        (f'<div alt="my class=ad" class=post><p>{BODY}</p></div>', BODY),
    ],
)
def test_quotes_count_after_an_equals_sign_only(spark, page, want):
    rows = [(1, "http://a/1", page), (2, None, page)]
    assert [r.text for r in he.extract_pages(pages(spark, *rows)).collect()] == [want] * 2


@pytest.mark.parametrize(
    "page",
    [
        "<article class=post><p>{0}</p></article><section id=comments><article class=comment-body><p>{1}</p></article></section>",
        "<article class=post><p>{0}</p></article><section id=comments><article><p>{1}</p></article></section>",
        "<article class=post><p>{0}</p><article class=comment><p>{1}</p></article></article>",
        "<main><p>{0}</p><ol class=commentlist><li><article><p>{1}</p></article></ol></main>",
        "<div class=post><p>{0}</p></div><div class=commentbody><p>{1}</p></div>",
    ],
)
def test_readers_comments_are_not_the_article(spark, page):
    page = f"<html><body><header>Head</header>{page.format(BODY * 2, LAST * (1 if 'commentbody' in page else 9))}</body></html>"
    rows = [(k, url, page) for k, url in enumerate(["http://a/1", "http://a/2", None])]
    assert [r.text for r in he.extract_pages(pages(spark, *rows)).collect()] == [BODY * 2] * 3


def test_time_grows_with_the_page_not_with_its_square():
    import time

    def seconds(page):
        began = time.perf_counter()
        found = list(he.blocks(page))
        text = he.article_text(found, he.best(he.scores(found)))
        assert "word" in text
        return time.perf_counter() - began

    for unit in ("<div>word. ", "<ul><li>word. ", "<b>word </i>", "<div class=a1><p>word", "<p title=a'>word "):
        small, large = seconds(unit * 5_000), seconds(unit * 40_000)
        assert large < 30 * small + 2, unit
