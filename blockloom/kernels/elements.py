"""Canonical text of markup elements, so that template and JSX forms of one element compare alike."""

from __future__ import annotations

import re

#: Fixed patterns, applied in this order.
_listener = re.compile(r"\$\{\{\s*handleEvent\s*:\s*([^,}]+?)\s*,[^}]*\}\}")
_quoted = re.compile(r'"\{([^{}]*)\}"')
_prefixed = re.compile(r"([\s<])(?:\?|\.|@|bool:)([A-Za-z][A-Za-z0-9_:.-]*)")
_event = re.compile(r"([\s<])on([A-Z][A-Za-z0-9_]*)")
_closer = re.compile(r"</[A-Za-z][A-Za-z0-9_:.-]*>")


def plain_text(source: str) -> str:
    """Source with every run of white space as one space."""
    return " ".join(source.split())


def element_text(source: str) -> str:
    s = plain_text(source)
    if not any(c in s for c in ' <"$/'):
        return s  # every rule below takes one of them
    lowered = lambda m: m[1] + m[2].lower()
    s = _listener.sub(r"{\1}", s).replace("${", "{")
    s = _event.sub(lowered, _prefixed.sub(lowered, _quoted.sub(r"{\1}", s)))
    return _closer.sub(">", s.replace("/>", ">"))
