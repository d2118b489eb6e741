"""Main text of pages written by hand, apart from the generator that the field is trained on."""

import time

import pytest

from trialspark.llm import html_crf

PAGES = {
    "article at the root, a form within": ("<article><p>a &lt;b&gt; &amp;c &#233;</p><form><p>no</p></form><p>d\n\t e</p>", "a <b> &c é\n\nd e"),
    "the same below html and body": ("<html><body><article><p>a &lt;b&gt; &amp;c &#233;</p><form><p>no</p></form><p>d e</p></article></body></html>", "a <b> &c é\n\nd e"),
    "a paragraph that is mostly a link": ("<article><p>See <a>one long link text that goes on and on for a while</a></p><p>End.</p></article>", "See one long link text that goes on and on for a while\n\nEnd."),
    "no markup": ("plain words only", "plain words only"),
    "a letter to sign up for": ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>First paragraph of the story.</p><form><p>Sign up for our weekly letter and never miss a thing.</p><input><button>Go</button></form><p>Second paragraph.</p></article><footer>c</footer></body></html>", "Title here\n\nFirst paragraph of the story.\n\nSecond paragraph."),
    "divs with names": ("<html><body><div id='header'><a href='/'>Site</a></div><div id='content'><h1>News of today</h1><p>The river rose over night, and the bridge was closed.</p><p>No one was hurt.</p></div><div id='sidebar'><h3>Related</h3><ul><li><a href=x>One</a></li></ul></div><div id=footer>Copyright 2020</div></body></html>", "News of today\n\nThe river rose over night, and the bridge was closed.\n\nNo one was hurt."),
    "comments that are articles": ("<html><body><article><h1>T</h1><p>Body of the text is here.</p></article><section id='comments'><h2>2 comments</h2><article class='comment'><p>I like this text very much, thanks for writing it.</p></article></section></body></html>", "T\n\nBody of the text is here."),
    "a form around the page": ("<html><body><form id='aspnetForm'><div class='menu'><ul><li><a href=x>Home</a></li></ul></div><article><h1>Head</h1><p>A paragraph inside the page's form.</p></article></form></body></html>", "Head\n\nA paragraph inside the page's form."),
    "what isn't shown": ("<article><p>Seen text stays.</p><div style='display:none'><p>Not seen at all here.</p></div><aside>More from us</aside><p>It ends.</p></article>", "Seen text stays.\n\nIt ends."),
    "a header and a byline": ("<html><body><header><p>The Daily Paper</p></header><main><h1>Head line</h1><p class=byline>By A. Writer</p><p>Text goes on here for a while.</p></main></body></html>", "Head line\n\nText goes on here for a while."),
    "cut off": ("<html><body><nav><ul><li><a href='/a'>A</a></ul></nav><article><h1>Cut</h1><p>One two thr", "Cut\n\nOne two thr"),
    "references and white space": ("<article><p>R&amp;D&nbsp;&mdash; &#x41;&#66;\n\n  c<br>d</p></article>", "R&D — AB c d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_crf.main_text(page, html_crf.model()) == want


@pytest.mark.parametrize("part", ["<div class='c'>", "<b>y", "</i>", "<p>z</p>", "<ul><li>", "<form><p>no</p>"])
def test_nesting_is_read_in_linear_time(part):
    def took(n: int) -> float:
        began = time.perf_counter()
        html_crf.main_text(part * n + "<article><p>x</p></article>", html_crf.model())
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 12 * max(0.05, took(4_000))
