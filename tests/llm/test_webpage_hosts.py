"""Pages of a host whose number is no multiple of a batch, and wrappers whose class names another part."""

import pytest

from evidrel.llm import webpage


@pytest.mark.parametrize("n", [66, 129, 130])
def test_last_pages_of_a_host_are_aligned(spark, n):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Terms of this site</div><section><p>Page {i} says {i * 7919}</section>") for i in range(n)]
    got = webpage.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Page {i} says {i * 7919}" for i in range(n)}


TEXT = "<p>Main text of the page, which is long enough.<p>More of it."
MAIN = "Main text of the page, which is long enough.\n\nMore of it."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="has-sidebar"><article>{TEXT}</article></div>',
        f'<body><div class="layout no-sidebar"><div>{TEXT}</div></div>',
        f'<body><div id="content-with-ads"><div>{TEXT}</div></div><div class="ad">Buy</div>',
        f'<body><div class="sidebar-layout"><div>{TEXT}</div><div class="sidebar">Side</div></div>',
        f'<body><div class="headerLayout"><article>{TEXT}<div class="comments">{TEXT * 3}</div></article></div><div class="related"><article>Other</article></div>',
        f'<body><main><div class="widget-page"><div>{TEXT}</div></div></main><div class="notice">We use cookies</div>',
        f'<body><article>{TEXT}<div class="share">Share this</div></article><div class="sidebar"><article>{TEXT * 3}</article></div>',
    ],
)
def test_wrappers_keep_their_text_and_declared_parts_go(page):
    assert webpage.extract([page]) == [MAIN]


def test_names_before_another_word_are_no_parts():
    page = "<body><article><h1>Title</h1><div class='search-story'><p>A story of a search</div><p class='notice-of-meeting'>The meeting is on Monday<div class='cookie-notice'>We use cookies</div><div class='ad-slot'>Buy</div></article>"
    assert webpage.extract([page]) == ["Title\n\nA story of a search\n\nThe meeting is on Monday"]


def test_copies_keep_their_heading_and_text():
    page = "<body><nav>menu {0}</nav><div class=story><article><h1>Big story</h1><p>What happened, at some length, in a few words.<p>And then the rest of it.</article></div><div>seen {0} times</div>"
    own = ["Big story\n\nWhat happened, at some length, in a few words.\n\nAnd then the rest of it."]
    assert webpage.extract([page.format(1)]) == own and webpage.extract([page.format(i) for i in range(6)]) == own * 6


def test_a_constant_member_of_a_run_is_template():
    page = "<body><div class=story><h2>Page {0}</h2><p>Paragraph {0} is of this page alone, and longer.<p>Join our mailing list today<p>So is the second, which says {1}.</div>"
    got = webpage.extract([page.format(i, i * 7919) for i in range(12)])
    assert got == [f"Page {i}\n\nParagraph {i} is of this page alone, and longer.\n\nSo is the second, which says {i * 7919}." for i in range(12)]


def test_deep_nesting_stays_inside_what_is_dropped():
    page = "<body><footer>" + "<div>" * 5000 + "small print" + "</div>" * 5000 + "</footer><main><p>The text</main>" + "<p>" * 3000 + "</q>" * 3000
    assert webpage.extract([page]) == ["The text"]


def test_many_siblings_are_matched_as_few_are(monkeypatch):
    import random

    rng = random.Random(3)
    for _ in range(30):
        trees = []
        for _ in range(2):
            kids = "".join(rng.choice(["<div><p>x</div>", "<ul><li>y</ul>", "<h2>z</h2>", "<section><h3>t</h3><p>u</section>"]) for _ in range(rng.randint(1, 14)))
            trees.append(webpage.Folded(webpage.parse(f"<main>{kids}</main>")))
        monkeypatch.setattr(webpage, "CELLS", 250_000)
        size, _ = webpage.tree_match(*trees)
        monkeypatch.setattr(webpage, "CELLS", 0)
        large, pairs = webpage.tree_match(*trees)
        assert large == size == len(pairs) == len(set(pairs)) and all(trees[0].keys[i] == trees[1].keys[j] for i, j in pairs)


def test_linked_headlines_and_paragraphs_stay_and_lists_of_links_go():
    page = "<html><body><h2>Section about <a href=x>a long linked heading of this page</a></h2><p>See <a href=y>this whole paragraph is a link to more</a></p><p>Plain text of the page stays as it is, all of it, and is long enough.</p>"
    page += "<ul><li><a href=1>Home</a></li><li><a href=2>About</a></li><li><a href=3>Contact</a></li></ul><div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><ul><li><a href=q>Only</a> item with words</li><li>Second</li></ul></body></html>"
    text = webpage.extract([page])[0]
    assert "a long linked heading of this page" in text and "this whole paragraph is a link to more" in text
    assert "Home" not in text and "Two" not in text and "Only item with words" in text and "Second" in text
