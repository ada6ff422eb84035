"""Stack fold on token lists (FIXTURES M1-M4), no Spark needed."""
import re

from pagesift.config import TOKEN_RE
from pagesift.functions.fold import fold_tokens


def fold(h):
    k, n, t, s, tag, cls, a, r, par, dep = fold_tokens(re.findall(TOKEN_RE, h))
    assert par == [x[-1] if x else None for x in a] and dep == [len(x) + 1 for x in a]
    return [dict(kind=k[i], name=n[i], syn=s[i], tag=tag[i], cls=cls[i], anc=a[i], run=r[i]) for i in range(len(k))]


def test_m1_text_after_end_tag():
    ev = fold('<html><body><p class="x">Hi there</p>tail<div>yo</div></body></html>')
    assert [(e["kind"], e["name"]) for e in ev] == [
        ("start", "html"), ("start", "body"), ("start", "p"), ("end", "p"), ("start", "div"),
        ("end", "div"), ("end", "body"), ("end", "html")]
    assert ev[2]["run"] == "Hi there" and ev[3]["run"] == "tail" and ev[4]["run"] == "yo"
    assert ev[2]["cls"] == "x" and ev[3]["anc"] == [0, 1] and ev[7]["anc"] == []


def test_m2_repair_and_stray_end():
    h = "<html><body><p><b>one<p>two</p></body></html>"
    ev = fold(h)
    got = [("/" if e["kind"] == "end" else "") + e["name"] + ("*" if e["syn"] else "") for e in ev]
    assert got == ["html", "body", "p", "b", "p", "/p", "/b*", "/p*", "/body", "/html"]
    assert ev[3]["run"] == "one" and ev[4]["run"] == "two" and ev[4]["anc"] == [0, 1, 2, 3]
    assert fold(h.replace("</body>", "</i></body>")) == ev


def test_m3_void_ancestor():
    ev = fold('<html><body><input type="text"/><p>x</p></body></html>')
    p = ev[3]
    assert p["name"] == "p" and p["anc"] == [0, 1, 2] and ev[2]["tag"] == "input"
    body_end = [e for e in ev if e["kind"] == "end" and e["name"] == "body"][0]
    assert body_end["anc"] == [0]
    ev2 = fold("<html><body><wbr/><p>x</p></body></html>")
    assert ev2[2]["tag"] == "wbr/"


def test_m4_depth():
    h = "<html><body>" + "<div>" * 20 + "deep" + "</div>" * 20 + "</body></html>"
    ev = fold(h)
    leaf = [e for e in ev if e["run"] == "deep"][0]
    assert len(leaf["anc"]) + 1 == 22


def test_outside_html_and_eof():
    ev = fold("junk<p>x</p><html><body><p>aaa")
    assert ev[0]["name"] == "html" and ev[-1]["syn"] and ev[-1]["name"] == "html"
    assert ev[2]["run"] == "aaa"
    assert fold("<p>no html here</p>") == []


def test_self_closing_non_void_is_start_and_end():
    ev = fold("<html><body><div/>t</body></html>")
    assert [(e["kind"], e["name"]) for e in ev[2:4]] == [("start", "div"), ("end", "div")]
    assert ev[3]["run"] == "t"
