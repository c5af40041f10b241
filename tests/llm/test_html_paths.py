import pytest

from plumbline.llm import html_paths as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, and you agree.</p></div>
<div class="page"><h1>The &amp; title</h1><div class="text"><p><b>First   paragraph, with
commas, and &#233;nough text.<br><p>Second one; it goes on, for a while. Quite long.</p><ul><li>item one, too<li>item two</ul></div></div>
<div id="comments"><p>Great post, thanks. I liked it, a lot, really and truly.</p></div>
<form><p>Your name, please.</p></form><aside>Related, things.</aside><footer>&copy; All rights.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert H.main_blocks(PAGE) == [
        "The & title", "First paragraph, with commas, and énough text.", "Second one; it goes on, for a while. Quite long.", "item one, too", "item two",
    ]


def test_declared_article_is_whole():
    page = "<body><div class=ad>Buy, now. Buy, more.</div><article><h1>T</h1><p>Short.</p></article><p>Long, long text that is, well, beside it.</p>"
    assert H.main_blocks(page) == ["T", "Short."]


def test_list_of_links_has_a_low_ratio():
    links = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>A sentence, with commas. {'More of it, and more. ' * 5}</p><p>Another, again.</p></div>"
    assert len(H.main_blocks(page)) == 2


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []), ("plain", ["plain"]), ("<p>one<p>two", ["one", "two"]), ("<script>var a = '<p>x</p>';</script>", []), ("a &lt;b&gt; &am", ["a <b> &am"]),
        ("<p>cut <a hre", ["cut"]), ("<!-- <p>x</p> --><p>y</p>", ["y"]), ("</div></p>text<br>more", ["text more"]), ("<p hidden>x</p><p>y</p>", ["y"]), ("<p>3 < 4</p>", ["3 < 4"]),
    ],
)
def test_broken_markup(page, blocks):
    assert H.main_blocks(page) == blocks


def test_scores_by_hand():
    runs = [H.Run("a/p", (1, 2), "One, two.", 0), H.Run("a/p", (1, 3), "Three.", 0), H.Run("a/ul", (1, 4), "link", 4)]
    scores = H.path_scores(runs, H.Ratios(reach=0))
    assert scores["a/p"][:2] == (7.5, 1.5) and scores["a/ul"] == (0.0, 0.0, 0.0)


def test_given_pages_equal_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for row in pages.collect():
        inside = row.html.split("<article>")[1].split("</article>")[0].replace("<b>", "")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[row.page_id] == "\n".join(b for b in blocks if b)


def test_hard_cases_and_empty_table(table, nothing):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>x"), (2, "u", "<p>" + "long text, " * 200_000), (3, "u", "<div>" * 5000 + "deep")]
    got = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in H.extract(table(rows, "page_id int, url string, html string")).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (1, "u", 0, 0), (None, "u", 1, 1), (2, "u", 2_199_999, 2_199_999), (3, "u", 4, 4)], key=repr)
    assert H.extract(table([], "page_id int, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<p>See <a href="/wiki/hidden-figures">the film</a>, now.</p>', "See the film, now."), ('<p title="the hidden valley">A valley, far.</p>', "A valley, far."),
        ('<p><a href="/x?id=comment-5">The thread</a>, again.</p>', "The thread, again."), ('<p data-class="ad" data-id="menu">Real, text.</p>', "Real, text."),
        ('<section id="side-effects"><p>Rare, mild.</p></section>', "Rare, mild."), ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<div id="search-algorithms"><p>Trees, heaps.</p></div>', "Trees, heaps."), ('<p>A <span id="legal-history">long</span>, story.</p>', "A long, story."),
        ("<figure><img src=a><figcaption>A boat, at sea.</figcaption></figure>", "A boat, at sea."), ("<p>One <svg/>two <math />three <object data='x'/>four, five.</p>", "One two three four, five."),
    ],
)
def test_nothing_is_taken_for_side_matter_by_accident(part, kept):
    page = f"<body><article><h1>T</h1><p>Some text, and more of it.</p>{part}<p>The end, at last.</p></article><p>Beside.</p>"
    assert H.main_blocks(page) == ["T", "Some text, and more of it.", kept, "The end, at last."]


@pytest.mark.parametrize("part", ['<p class="share">x, y</p>', "<p hidden=''>x, y</p>", "<p STYLE='display: NONE'>x, y</p>", '<p aria-hidden="true">x, y</p>', "<p role=dialog>x, y</p>", "<svg><text>x</text></svg>"])
def test_declared_side_matter_stays_out(part):
    assert H.main_blocks(f"<body><article><p>Some text, and more.</p>{part}<p>The end, at last.</p></article>") == ["Some text, and more.", "The end, at last."]


LONG = "<p>A long paragraph, with commas, and more. It says a lot, in many words, again and again.</p><p>Another one, as long as that. It goes on, and on, for a good while, then ends.</p>"
BOTH = ["A long paragraph, with commas, and more. It says a lot, in many words, again and again.", "Another one, as long as that. It goes on, and on, for a good while, then ends."]


@pytest.mark.parametrize(
    "wrapper",
    ['class="site has-sidebar"', 'class="container no-sidebar"', 'class="page search-results"', 'class="post social-share-enabled"', 'class="ad-free"', 'id="related-work"',
     'class="modal"', 'class="layout-with-sidebar"', 'class="sidebar"', 'class="commentary"', 'class="headerless navigable"'],
)
def test_the_article_survives_its_wrappers(wrapper):
    assert H.main_blocks(f"<body><nav><a href=/>Home</a></nav><div {wrapper}><h1>T</h1>{LONG}</div><footer>F</footer></body>") == ["T", *BOTH]


@pytest.mark.parametrize("part", ['<p class="legal">The law, as it stands, is old.</p>', '<section class="search"><p>The law, as it stands, is old.</p></section>'])
def test_topics_stay_in_a_declared_article(part):
    assert H.main_blocks(f"<body><article>{LONG}{part}</article></body>") == [*BOTH, "The law, as it stands, is old."]


@pytest.mark.parametrize(
    "part",
    ['<ul class="commentlist"><li>Nice, very nice, I say.</ul>', '<ol class="comment-list"><li>Nice, very nice.</ol>', '<div class="user-notes"><p>Nice, very nice.</p></div>',
     '<div id="reader-comments"><p>Nice, very nice.</p></div>', '<section><h2>3 Comments</h2><ul><li>Nice, very nice.<li>Yes, indeed, it is.</ul></section>',
     '<div class="postComments2"><p>Nice.</p></div>', '<div class="share-buttons"><p>Share, now.</p></div>', '<div class="cookieBanner"><p>We use cookies, yes.</p></div>',
     f'<div class="comments">{LONG}{LONG}{LONG}</div>'.replace("long", "nice")],
)
def test_comments_and_notices_go(part):
    assert H.main_blocks(f"<body><div><h1>T</h1>{LONG}</div>{part}</body>") == ["T", *BOTH]


def test_nested_inline_side_matter_ends_at_its_own_tag():
    page = "<p>Text, and <span class=share><span>x</span> SHARE <b>y</b></span>more, of it.<p>So, <span class=share>open"
    assert H.main_blocks(page) == ["Text, and more, of it.", "So, open"]


def test_choice_equals_a_plain_version():
    """Scores, threshold and the innermost element that holds the content, step by step on trees of random blocks."""
    import math
    import random

    rng = random.Random(4)
    for _ in range(60):
        runs = [
            H.Run(rng.choice(["body/div/p", "body/div/ul/li", "body/p", "body/div/div/p"]), (), "word, " * rng.randrange(1, 30) if rng.random() < 0.6 else "link", 0) for _ in range(12)
        ]
        paths = list(dict.fromkeys(r.path for r in runs))
        mean = {p: [sum(f(r) for r in runs if r.path == p) / sum(r.path == p for r in runs) for f in (lambda r: len(r.text), lambda r: r.text.count(","))] for p in paths}
        smooth = []
        for k in range(len(paths)):
            near = [(math.exp(-((j - k) ** 2) / 2), mean[paths[j]]) for j in (k - 1, k, k + 1) if 0 <= j < len(paths)]
            weights = sum(w for w, _ in near)
            smooth.append([sum(w * m[c] for w, m in near) / weights for c in (0, 1)])
        scores = H.path_scores(runs, H.Ratios())
        for p, (length, punctuation) in zip(paths, smooth):
            want = length * math.log1p(punctuation) ** 0.5 * math.log1p(mean[p][0])
            assert math.isclose(scores[p][2], want, rel_tol=1e-9) and math.isclose(scores[p][0], mean[p][0])
