"""A name sets menus, comments and the like apart, not articles, layouts, headings or titled sections."""
import pytest

from pagesift.llm import wrapper


@pytest.mark.parametrize("source, text", [
    ("<div class='content with-sidebar'><article><p>a</p></article></div>", "a"), ("<main class='has-sidebar'><p>a</p></main>", "a"),
    ("<article class='post comments-open'><p>a</p></article>", "a"), ("<article id='post-share'><p>a</p></article>", "a"),
    ("<main><h2 id='related-work'>Related</h2><p>a</p></main>", "Related a"), ("<main><section id='search-methods'>s</section></main>", "s"),
    ("<div class='sidebar'><main><p>a</p></main><nav>n</nav></div><p>b</p>", "a"), ("<div class=hasMenu><p>a</p></div>", "a"),
    ("<div id='social'><article>the story</article></div><p>x</p>", "the story"),
    # what the list is for
    ("<article>a<section id='comments'>c</section></article>", "a"), ("<article>a<section id='comments-section'>c</section></article>", "a"),
    ("<article>a</article><div id='comments'><article class='comment'>a long comment</article></div>", "a"),
    ("<div class='sidebar'><article>teaser</article><article>teaser</article></div><p>text</p>", "text"),
    ("<div class='sidebar'><article>teaser</article></div><p>a text of a page</p>", "a text of a page"),
    ("<aside><main>m</main></aside><p>a</p>", "a"), ("<main>a<div class='sidebar'>s</div><div class=related>r</div></main>", "a")])
def test_names_of_parts(source, text):
    assert wrapper.Page(source).main_text() == text
