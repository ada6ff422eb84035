"""Raw elements that are never closed lose their tag alone."""
import pytest

from pagesift.llm import wrapper


@pytest.mark.parametrize("source, text", [
    ("<article><p>a</p><iframe src='x'/><p>b</p></article>", "a b"), ("<p>a</p><iframe src='x'><p>b</p>", "a b"),
    ("<iframe src=x><p>a</p><iframe src=y>in</iframe><p>b</p>", "a b"), ("<p>a</p><noscript/><p>b</p><noscript>n</noscript>c", "a b c"),
    ("<p>a</p><template><p>b</p>", "a b"), ("<p>a<textarea>t</textarea>b</p>", "a b"), ("<title>t</title><p>a</p>", "a"),
    ("<p>a</p><iframe>x</iframe>b</iframe>c", "a bc"), ("<p>a</p><script>x", "a"), ("<p>a</p><style/>p{}", "a")])
def test_raw_elements(source, text):
    assert wrapper.Page(source).main_text() == text


def test_many_open_tags_take_linear_time():
    assert wrapper.Page("<p>a</p>" + "<iframe src=x>" * 50_000).main_text() == "a"
