"""Per-page stack fold: token list -> ordered tag events.

Pure Python, no Spark import, so it is unit-testable on its own and serves as
the body of an Arrow-batched pandas UDF (one page per row, no shuffle).

Two stacks are kept:

* the *repair* stack (non-void element names) decides how the tree is
  repaired: an end tag closes the nearest open element of that name and
  emits synthetic ends for everything opened inside it; an end tag with no
  open element is ignored; open elements are closed at end of input;
* the *path* stack holds every start event including void elements, which
  are only removed when an enclosing element closes (they become ancestors
  of their later siblings). Its names are the path names: the element name,
  or ``name/`` for a void element written without attributes.

Only the subtree of the first ``html`` element is emitted. The text after a
token belongs to the last event emitted for that token; text after an
ignored token joins the previous event's text. Synthetic ends carry no text.
"""

from __future__ import annotations

import html as _html
import re

from pagesift import config as C

_VOID = frozenset(C.VOID_TAGS)
_START = re.compile(rf"<({C.TAG_NAME})(?:[{C.BLANK}]|/(?!>))*+")
_END = re.compile(rf"</([A-Za-z][^{C.BLANK}/>]*+)|</[{C.BLANK}]++([A-Za-z][^{C.BLANK}/>]*+)[{C.BLANK}]*+>")
_CLASS = re.compile(C.CLASS_RE)
_ATTR = re.compile(rf"{C.ATTRIBUTE}(?:[{C.BLANK}]|/(?!>))*+")


def _escape(v: str) -> str:
    return v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(token: str) -> tuple[str, str, bool] | None:
    """(name, tag text, closed at once) of a start-tag token; None if it only looks like one.

    The text is as the tree builder writes it back: lower-case attribute
    names, every value double-quoted (valueless ones as ""), class blanks
    collapsed, values decoded once more and & < > escaped, "/" on voids.
    """
    m = _START.match(token)
    if m is None:
        return None
    name, at, attrs = m.group(1).lower(), m.end(), []
    while m := _ATTR.match(token, at):
        at = m.end()
        n, v = m.group(1).lower(), m.group(2) or ""
        if len(v) >= 2 and v[0] in "'\"" and v[-1] == v[0]:
            v = v[1:-1]
        if "&" in v:
            v = _html.unescape(v)
        if n == "class":
            v = " ".join(v.split())
        attrs.append(f'{n}="{_escape(v)}"')
    rest = token[at:].strip()
    if rest not in (">", "/>"):
        return None
    return name, name + (" " + " ".join(attrs) if attrs else "") + ("/" if name in _VOID else ""), rest == "/>"


def fold_tokens(tokens, max_anc: int | None = None):
    """Return parallel lists ``(kind, name, raw, synthetic, tag, cls, anc, run, parent, depth)``.

    ``raw`` is the canonical tag text (``/name`` for ends); ``tag`` the path
    name, i.e. the first word of ``raw``; ``cls`` the first class="..." value
    of ``raw``; ``anc`` the event positions of the path stack below the
    event (root first); ``run`` the decoded text following the token.
    """
    kinds: list[str] = []
    names: list[str] = []
    toks: list[str | None] = []
    tags: list[str] = []
    clss: list[str] = []
    synth: list[bool] = []
    ancs: list[list[int]] = []
    parents: list[int | None] = []
    depths: list[int] = []
    runs: list[list[str]] = []
    rstack: list[str] = []
    pnames: list[str] = []
    ppos: list[int] = []
    started = False
    last = -1

    def emit(kind, name, raw, synthetic):
        kinds.append(kind)
        names.append(name)
        if kind == "start":
            toks.append(raw)
            tags.append(raw.split(" ", 1)[0])
            mc = _CLASS.search(raw)
            clss.append(mc.group(1) if mc else "")
        else:
            toks.append("/" + name)
            tags.append("/" + name)
            clss.append("")
        synth.append(synthetic)
        ancs.append(list(ppos) if max_anc is None else ppos[:max_anc])
        parents.append(ppos[-1] if ppos else None)
        depths.append(len(ppos) + 1)
        runs.append([])
        return len(kinds) - 1

    def close_top(tok, synthetic):
        name = rstack.pop()
        # the path stack pops through to the element being closed
        while pnames and pnames[-1] != name:
            pnames.pop()
            ppos.pop()
        if pnames:
            pnames.pop()
            ppos.pop()
        return emit("end", name, tok, synthetic)

    if tokens is None:
        tokens = []
    for i, t in enumerate(tokens):
        end = tag = None
        if len(t) > 2 and t[0] == "<" and t[-1] == ">":
            if t[1] in "!?/" and not t.startswith("<!--"):
                end = _END.match(t)
                if end is None:
                    continue  # declarations and nameless end tags are dropped
            else:
                tag = start_tag(t)
        if end is None and tag is None:
            if started:
                runs[last].append(t)
        elif tag:
            name, raw, closed = tag
            if not started:
                if name != "html":
                    continue
                started = True
            path_name = raw.split(" ", 1)[0]
            last = emit("start", name, raw, False)
            pnames.append(path_name)
            ppos.append(last)
            if name not in _VOID:
                rstack.append(name)
                if closed:  # <div/> is an empty element: start and end
                    last = close_top(i, True)
        else:
            name = (end.group(1) or end.group(2)).lower()
            if not started or name not in rstack:
                continue  # stray end tag: ignored, its text joins the previous event
            while rstack[-1] != name:
                close_top(i, True)
            last = close_top(i, False)
        if started and not rstack:
            break  # html closed: the rest of the page is outside the subtree
    while started and rstack:
        close_top(-1, True)
    text = []
    for parts in runs:
        s = "".join(parts)
        text.append(_html.unescape(s) if "&" in s else s)
    return kinds, names, toks, synth, tags, clss, ancs, text, parents, depths
