"""Top-level elements of markup inside a template literal or a page."""

from __future__ import annotations

import re

#: Fixed: elements that never have a closing tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_name = re.compile(r"[A-Za-z0-9_:-]*")
_tag = re.compile(r"<(?=[A-Za-z])|</|\$\{")
_hole_part = re.compile(r"[{}\"']")
_open_part = re.compile(r"[\"'>]|\$\{|/>")


def hole_end(body: str, at: int) -> int:
    """Index after the interpolation that begins at `at`."""
    depth, i = 1, at + 2
    while depth:
        m = _hole_part.search(body, i)
        if not m:
            return len(body)
        i = m.end()
        if m[0] in "\"'":
            q = re.compile(rf"(?:[^{m[0]}\\]|\\[\s\S])*{m[0]}?").match(body, i)
            i = q.end() if q else len(body)
        else:
            depth += 1 if m[0] == "{" else -1
    return i


def _attribute_end(body: str, at: int) -> int:
    i = at + 1
    while i < len(body):
        if body[i] == "\\":
            i += 2
        elif body[i] == body[at]:
            return i + 1
        elif body.startswith("${", i):
            i = hole_end(body, i)
        else:
            i += 1
    return len(body)


def _open_end(body: str, at: int) -> tuple[int, bool]:
    """(index after the opening tag, whether it closes itself); -1 if it never ends."""
    i = at
    while m := _open_part.search(body, i):
        if m[0] == ">":
            return m.end(), False
        if m[0] == "/>":
            return m.end(), True
        i = hole_end(body, m.start()) if m[0] == "${" else _attribute_end(body, m.start())
    return -1, False


def tag_name(body: str, at: int) -> str:
    return _name.match(body, at)[0]


def element_end(body: str, at: int) -> int:
    """Index after the element that begins at `at`; -1 where its tags don't match."""
    name = tag_name(body, at + 1)
    i, closed = _open_end(body, at + 1 + len(name))
    if i < 0 or closed or name.lower() in VOID:
        return i
    stack = [name]
    while m := _tag.search(body, i):
        if m[0] == "${":
            i = hole_end(body, m.start())
        elif m[0] == "</":
            close = tag_name(body, m.end())
            i = body.find(">", m.end()) + 1 or len(body)
            if close == stack[-1]:
                stack.pop()
                if not stack:
                    return i
        else:
            name = tag_name(body, m.end())
            i, closed = _open_end(body, m.end() + len(name))
            if i < 0:
                return -1
            if not closed and name.lower() not in VOID:
                stack.append(name)
    return -1


def elements(body: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the top-level elements; interpolations are passed over whole."""
    out, i = [], 0
    while m := _tag.search(body, i):
        i = m.end()
        if m[0] == "${":
            i = hole_end(body, m.start())
        elif m[0] == "<" and (end := element_end(body, m.start())) >= 0:
            out.append((m.start(), end, tag_name(body, m.end())))
            i = end
    return out
