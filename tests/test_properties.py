"""Structural invariants of the stack fold on random token streams (hypothesis)."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.config import TOKEN_RE, VOID_TAGS
from pagesift.functions.fold import fold_tokens

NAMES = ["html", "body", "div", "p", "b", "li", "input", "wbr"]
piece = st.one_of(
    st.sampled_from(NAMES).map(lambda n: f"<{n}>"),
    st.sampled_from(NAMES).map(lambda n: f"</{n}>"),
    st.sampled_from(NAMES).map(lambda n: f"<{n}/>"),
    st.sampled_from(["x", "yy", " ", "a b", "<", "<!x>"]),
)
page = st.lists(piece, min_size=0, max_size=60).map(lambda ps: "".join(ps))


def events(h):
    k, n, raw, syn, tag, cls, anc, run, par, dep = fold_tokens(re.findall(TOKEN_RE, h))
    head = fold_tokens(re.findall(TOKEN_RE, h), 3)
    assert head[6] == [a[:3] for a in anc] and head[8] == par and head[9] == dep
    return list(zip(k, n, raw, syn, tag, cls, anc, run))


@settings(max_examples=400, deadline=None)
@given(page)
def test_balanced_and_nested(h):
    ev = events(h)
    if not ev:
        assert not re.search(r"<html[\s/>]", h, re.I)
        return
    assert ev[0][0] == "start" and ev[0][1] == "html" and ev[0][6] == []
    assert ev[-1][0] == "end" and ev[-1][1] == "html"
    stack = []  # non-void open elements
    for i, (kind, name, raw, syn, tag, cls, anc, run) in enumerate(ev):
        assert all(a < i for a in anc) and anc == sorted(anc)
        for a in anc:
            assert ev[a][0] == "start"
        if kind == "start":
            if name not in VOID_TAGS:
                stack.append((name, i))
            assert tag == raw.split(" ")[0]
        else:
            assert stack and stack[-1][0] == name  # ends close the innermost open element
            stack.pop()
            assert tag == "/" + name
    assert stack == []


@settings(max_examples=400, deadline=None)
@given(page)
def test_ancestors_are_a_chain(h):
    ev = events(h)
    for i, e in enumerate(ev):
        anc = e[6]
        if anc:
            parent = anc[-1]
            assert ev[parent][6] == anc[:-1]  # the parent's ancestors are a prefix


@settings(max_examples=400, deadline=None)
@given(page)
def test_text_inside_html_is_conserved(h):
    """Every text token between the html start and its end lands in exactly one run."""
    toks = re.findall(TOKEN_RE, h)
    ev = events(h)
    if not ev:
        return
    runs = "".join(e[7] for e in ev[:-1])
    # text tokens after the first <html> start and before the token that closes html
    start = next(i for i, t in enumerate(toks) if re.match(r"<html[\s/>]", t, re.I))
    inside = []
    for t in toks[start + 1:]:
        if not t.startswith("<") or t == "<":  # text tokens (declarations are dropped)
            inside.append(t)
    text = "".join(inside)
    # runs are the inside text in order, without loss or duplication, up to the token
    # that closes html (the final event's run is text after </html>)
    assert text.startswith(runs)
    if not re.search(r"</html>|<html/>", h, re.I):  # html closed only at end of input
        assert runs + ev[-1][7] == text
