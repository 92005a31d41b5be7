"""Lexical tokens of source text, to tell a change of formatting from one of meaning."""

from __future__ import annotations

import re

#: Fixed: operators of more than one character.
OPERATORS = (
    ">>>= >>> >>= <<= <<< &&= ||= ??= **= ->* <=> %:%: ## === !== ... ;;& "
    ">> << && || ?? ?. ++ -- ** .* <: :> <% %> %: == != <= >= => :: <- -> := += -= *= /= %= &= |= ^= =~ ;; ;&"
).split()
#: Fixed: tokens after which a slash begins a regular expression.
BEFORE_REGEX = set(
    "= => == === != !== < > <= >= << >> ( [ { , ; : ! & && &&= | || ||= ? ?? ??= ?. + - * ** **= % ^ ~ ++ -- += -= *= /= %= &= |= ^= :: -> <- =~ ... "
    "return case typeof instanceof in of new do else yield await delete void throw default".split()
)
C_FAMILY = ("c", "cpp")
_IDENT = "[A-Za-z0-9_$]"
_pieces = re.compile(f"{_IDENT}+|" + "|".join(re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True)) + r"|[\x00-\xff]")
_quoted = {q: re.compile(rf"{q}(?:[^{q}\\]|\\[\x00-\xff])*(?:{q}|\\?\Z)") for q in "\"'`"}
_line = re.compile(r"[^\n]*")
_block = re.compile(r"/\*[\x00-\xff]*?(?:\*/|\Z)")
_regex = re.compile(rf"/(?:\\[\x00-\xff]|\[(?:\\[\x00-\xff]|[^\]\\])*(?:\]|\Z)|[^/\\\[\n])*/{_IDENT}*")
_run = re.compile(r"(?:(?!//|/\*)[^ \t\n\r\"'`])+")
_c_text = re.compile(r"(?:u8|u|U|L)(?=[\"'])")
_raw = re.compile(r"(?:u8|u|U|L)?R\"")
_suffix = re.compile(f"{_IDENT}*")
_c_break = re.compile(rf"(?<!{_IDENT})(?:(?:u8|u|U|L)[\"']|(?:u8|u|U|L)?R\")")


def _quote_end(s: str, i: int) -> int:
    m = _quoted[s[i]].match(s, i)
    return m.end() if m else len(s)


def _expression_end(s: str, i: int) -> int:
    """Index after the brace that closes an interpolation whose inside begins at i; -1 if none does."""
    depth = 1
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
        elif c in "\"'`":
            i = _quote_end(s, i)
        else:
            depth += (c == "{") - (c == "}")
            i += 1
            if not depth:
                return i
    return -1


def _template(s: str, i: int, language: str) -> tuple[list[str], int]:
    """Tokens of a template literal: text whole, interpolations by token."""
    out, start, j = [], i, i + 1
    while j < len(s):
        if s[j] == "\\":
            j += 2
        elif s[j] == "`":
            return [*out, s[start : j + 1]], j + 1
        elif s.startswith("${", j):
            out.append(s[start : j + 2])
            end = _expression_end(s, j + 2)
            if end < 0:
                return [*out, s[j + 2 :]], len(s)
            out += tokens(s[j + 2 : end - 1], language)
            start = j = end
        else:
            j += 1
    return [*out, s[start:]], len(s)


def tokens(s: str, language: str = "") -> list[str]:
    """Tokens of a text whose bytes are given as Latin-1 characters; strings, comments and regular expressions are whole."""
    out: list[str] = []
    i, n, c_like = 0, len(s), language in C_FAMILY
    while i < n:
        c = s[i]
        if c in " \t\n\r":
            i += 1
            continue
        end = 0
        if c_like and (m := _c_text.match(s, i)):
            end = _quote_end(s, m.end())
            end = _suffix.match(s, end).end() if language == "cpp" else end
        elif c in "\"'":
            end = _quote_end(s, i)
        elif c == "`":
            if language == "go":
                end = s.find("`", i + 1) + 1 or n
            elif language == "bash":
                end = _quote_end(s, i)
            elif c_like:
                end = i + 1
            else:
                found, i = _template(s, i, language)
                out += found
                continue
        elif language == "cpp" and (m := _raw.match(s, i)):
            at = s.find("(", m.end())
            close = s.find(")" + s[m.end() : at] + '"', at) if at >= 0 else -1
            end = _suffix.match(s, close + at - m.end() + 2).end() if close >= 0 else n
        elif c == "#" and ((language == "bash" and (i == 0 or s[i - 1] in " \t\n\r;|&")) or (language != "bash" and not c_like and (i + 1 >= n or s[i + 1] in " \t\n\r"))):
            end = _line.match(s, i).end()
        elif s.startswith("//", i):
            end = _line.match(s, i).end()
        elif s.startswith("/*", i):
            end = _block.match(s, i).end()
        elif c == "/" and (not out or out[-1] == "" or out[-1].startswith(("//", "/*")) or out[-1] in BEFORE_REGEX) and (m := _regex.match(s, i)):
            end = m.end()
        if end:
            out.append(s[i:end])
        else:
            end = _run.match(s, i).end() if _run.match(s, i) else i + 1
            if c_like and (m := _c_break.search(s, i + 1, end + 1)):
                end = m.start()
            out += _pieces.findall(s[i:end])
        i = end
    return out


def formatting_only(old: bytes, new: bytes, old_language: str = "", new_language: str = "") -> bool:
    """Whether two different sources have the same tokens."""
    return old != new and tokens(old.decode("latin-1"), old_language) == tokens(new.decode("latin-1"), new_language)
