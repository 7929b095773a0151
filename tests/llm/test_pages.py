"""Operators over web pages."""

import random
import re

from tomeline.llm.html_text import LABELLED, extract_text, keeps, main_text, tree
from tomeline.llm.url_filter import Automaton, canonical, filter_urls, split_url

SCHEMA = "page_id long, url string, html string, text string, host string, rule string"


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 7))) for _ in range(90)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    hits = Automaton(patterns).match([t.encode() for t in texts])
    for j, p in enumerate(patterns):
        fits = re.compile(re.escape(p).replace(r"\*", ".*").replace(r"\?", "."), re.S)
        assert [bool(x) for x in hits[:, j]] == [fits.fullmatch(t) is not None for t in texts]


def test_split_url():
    assert split_url("HTTP://A.ExÄ.org/P/q?x#y") == ("a.exÄ.org", "/P/q")
    assert split_url("x://h?q/r") == ("h", "") and split_url("x://h#f") == ("h", "") and split_url("no scheme") == split_url(None) == ("", "") and split_url("a://b://c/d") == ("b:", "//c/d")


def test_filter_urls(spark):
    urls = [
        "https://a.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/en/1", "http://casino.net/",
        "http://casino.org/", "http://x.net/a.org/de/", "http://org/", "http://y.org?x", None, "mailto:a", "http://x.net/setup.exe", "http://com/de/\x01",
    ]
    table = spark.createDataFrame([(i, u, None, "", "", "") for i, u in enumerate(urls)] + [(None, urls[0], None, "", "", "")], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(table).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "block"),
        ("org/", "allow"), (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("com/de/", "block"),
    ]
    assert got[None] == ("example.org/es/", "block")
    assert filter_urls(table.limit(0)).count() == 0


def test_globs_see_the_canonical_address(spark):
    bad = ["http://x.net/Setup.EXE", "http://x.net/a%2Eexe", "http://x.net/%77p-login.php", "http://ca%73ino.net", "http://x.net/a%252Eexe", "http://u:p@poker.net:8080/", "http://POKER.net./", "http://my-poker.net", "http://x.net//wp-login.php", "http://x.net/./cgi-bin/a", "http://x.net/a.e%0Axe"]
    good = ["http://escortford.club/", "http://essexpoker.museum/", "http://x.net/a.exe.html", "http://x.net/poker", "http://x.net/?q=casino", "http://x.net/100%25", "http://x.net/%zz", "http://alphabets.net/", "http://x.net/%ff%fe"]
    table = spark.createDataFrame([(i, u, None, "", "", "") for i, u in enumerate(bad + good)], SCHEMA)
    got = {r.page_id: r.verdict for r in filter_urls(table).collect()}
    assert [got[i] for i in range(len(bad))] == ["block"] * len(bad) and [got[len(bad) + i] for i in range(len(good))] == ["allow"] * len(good)
    assert canonical("..A%2eb.:80", "//x/./y//z/") == ("a.b", "/x/y/z/")


def test_tree_fits_its_table():
    right = sum(keeps(row[:-1], tree()) == bool(row[-1]) for row in LABELLED)
    assert right >= 0.97 * len(LABELLED) and len(LABELLED) < 200


PARAGRAPH = "This paragraph has a good many words in it, far more than any menu would have &amp; no links."
PLAIN = PARAGRAPH.replace("&amp;", "&")


def test_main_region():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now</div>
    <article><header><h1>Head</h1></header><p><b>One</b>\n  two<br>three<p>{PARAGRAPH}<aside>{PARAGRAPH}</aside><ul><li>item<li>other</ul><form>Name <input></form></article>
    <section class="reader-comments"><article><p>{PARAGRAPH}</p></article></section><div id="cookieNotice">{PARAGRAPH}</div><footer>&copy; 2020</footer></body></html>"""
    assert main_text(page) == f"Head\nOne two three\n{PLAIN}\nitem\nother"


def test_hints_that_hold_the_whole_article_are_wrong():
    nav = "<nav><a href=/>Home</a></nav>"
    for page in (
        f'<body>{nav}<div class="layout has-sidebar"><article><p>{PARAGRAPH}</p></article><div class="sidebar">{PARAGRAPH}</div></div></body>',
        f'<body><form id="aspnetForm">{nav}<article><p>{PARAGRAPH}</p></article></form></body>',
        f'<body><a name="top"><article><p>{PARAGRAPH}</p></article></body>',
        f'<body>{nav}<main><div class="search-result social-policy"><p>{PARAGRAPH}</p></div></main></body>',
        f'<body>{nav}<div class="widget-page"><p>{PARAGRAPH}</p></div><div class="comments">no</div></body>',
    ):
        assert main_text(page) == PLAIN, page
    # Right hints stay: comments beside the article, however long, and forms in it.
    page = f'<article><p>{PARAGRAPH}</p><form>Your name <input></form></article><div class="comments"><article><p>{PARAGRAPH} {PARAGRAPH}</p></article></div>'
    assert main_text(page) == PLAIN
    assert main_text(f"<article><p><a href=/x>{PARAGRAPH}<div><p>{PARAGRAPH}</div></article>").endswith(PLAIN)


def test_page_without_main_region():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    page = f"<body><ul>{links}</ul><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><ul>{links}</ul><div class=footer>{PARAGRAPH}</div>"
    assert main_text(page) == f"{PLAIN}\n{PLAIN}"


def test_broken_pages():
    assert main_text("") == "" and main_text("<article><p>a < b</p><p cla") == "a < b" and main_text("<article>x<!-- open") == "x" and main_text("<article><p>x</p></div></article>") == "x"
    assert main_text("<article><p>" + "w " * 200_000 + "</p>").count("w") == 200_000
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"


def test_extract_text(spark):
    rows = [(1, "u", "<article><p>\u00e9&nbsp;x</p></article>", "", "", ""), (2, None, None, "", "", ""), (None, "u", "", "", "", ""), (1, "u", "<article><p>y", "", "", "")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(table).collect()), key=repr)
    assert got == sorted([(1, "u", "\u00e9 x", 3), (2, None, "", 0), (None, "u", "", 0), (1, "u", "y", 1)], key=repr)
    assert extract_text(table.limit(0)).count() == 0


def test_comments_menus_and_teasers():
    """Comments longer than the article, in whatever element; menus inside the main region; teasers of other articles."""
    long = f"{PARAGRAPH} " * 6
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12)) + "</ul>"
    article = f"<h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    for page in (
        f'<div class="post">{article}</div><div class="comments"><p>{long}</p><p>{long}</p></div>',
        f'<div>{article}</div><article class="comment"><p>{long}</p></article><article class="comment"><p>{long}</p></article>',
        f'<div class="widget-page">{article}</div><section id="comments"><div class="comment-body"><p>{long}</p></div></section>',
        f'<div class="content comments-open">{article}<div class="comments"><p>{long}</p></div></div>',
        f"<article>{menu}{article}</article>",
        f"<main>{article}{menu}</main>",
        f'<article>{article}</article><article class="teaser"><p>{long}</p></article>',
        f'<div>{article}</div><div class="related"><p>{long}</p></div>',
    ):
        assert main_text(f"<body>{page}</body>") == f"Head\n{PLAIN}\n{PLAIN}", page
    assert main_text(f'<body><div class="comments"><p>{PARAGRAPH}</p></div></body>') == PLAIN, "nothing is left without them"
