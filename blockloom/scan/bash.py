"""Blocks of Bash."""

from __future__ import annotations

import re

from .common import Scanner

_name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_assign = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\[[^\]\n]*\])?\+?=")
_function = re.compile(r"(?:function\s+([^\s(){};&|]+)\s*(?:\(\s*\))?|([^\s(){};&|#$'\"=]+)\s*\(\s*\))\s*(?=[{(])")
_here = re.compile(r"<<-?\s*(['\"]?)(\w+)\1")
#: Words that keep a command from having begun.
BEFORE_COMMAND = set("then do else elif if while until ! { ( time declare local export readonly typeset".split())


class BashScanner(Scanner):
    language = "bash"

    def walk(self) -> None:
        self.opened: list[str] = []
        self.commands(0, len(self.src), "", False)
        self.errors += len(self.opened)

    def quoted_end(self, at: int, end: int) -> int:
        q, i = self.src[at], at + 1
        while i < end:
            c = self.src[i]
            if c == "\\" and q != "'":
                i += 2
            elif c == q:
                return i + 1
            elif q == '"' and self.src.startswith("$(", i):
                i = self.nested_end(i + 1, end)
            else:
                i += 1
        self.errors += 1
        return end

    def nested_end(self, at: int, end: int) -> int:
        """Index after the bracket that closes the one at `at`."""
        close, depth, i = {"(": ")", "{": "}", "[": "]"}[self.src[at]], 0, at
        while i < end:
            c = self.src[i]
            if c == "\\":
                i += 2
                continue
            if c in "\"'`":
                i = self.quoted_end(i, end)
                continue
            if c == "#" and close != "]" and self.src[i - 1] in " \t\n;":
                i = self.line_end(i, end)
                continue
            depth += (c == self.src[at]) - (c == close)
            i += 1
            if not depth:
                return i
        self.errors += 1
        return end

    def line_end(self, at: int, end: int) -> int:
        n = self.src.find("\n", at, end)
        return end if n < 0 else n

    def word_end(self, at: int, end: int) -> int:
        """Index after a word: quotes and substitutions belong to it."""
        i = at
        while i < end and self.src[i] not in " \t\n;&|()<>":
            c = self.src[i]
            if c == "\\":
                i += 2
            elif c in "\"'`":
                i = self.quoted_end(i, end)
            elif c == "$" and self.src[i + 1 : i + 2] in ("(", "{"):
                i = self.nested_end(i + 1, end)
            else:
                i += 1
        return min(i, end)

    def commands(self, i: int, end: int, parent: str, inner: bool) -> None:
        fresh, here = True, []
        while i < end:
            c = self.src[i]
            if c == "\n":
                fresh, i = True, i + 1
                for mark in here:
                    m = re.compile(rf"^\t*{re.escape(mark)}$", re.M).search(self.src, i, end)
                    i = m.end() if m else end
                here = []
            elif c in " \t\r":
                i += 1
            elif c == "#" and (i == 0 or self.src[i - 1] in " \t\n;|&("):
                stop = self.line_end(i, end)
                self.add("comment", "", i, stop)
                i = stop
            elif fresh and (m := _function.match(self.src, i, end)) and (m[1] or m[2]) not in BEFORE_COMMAND:
                body = m.end()
                stop = self.nested_end(body, end)
                b = self.add("function", m[1] or m[2], i, stop, parent)
                self.commands(body + 1, max(body + 1, stop - 1), b.id, True)
                i, fresh = stop, False
            elif fresh and (m := _assign.match(self.src, i, end)):
                stop = self.nested_end(m.end(), end) if self.src[m.end() : m.end() + 1] == "(" else self.word_end(m.end(), end)
                if not inner:
                    self.add("variable", _name.match(self.src, i)[0], i, stop, parent)
                i = max(stop, m.end())
            elif c in ";&|":
                fresh, i = True, i + 1
            elif c in "({":
                self.opened.append(c)
                fresh, i = True, i + 1
            elif c in ")}":
                if self.opened and {"(": ")", "{": "}"}.get(self.opened[-1]) == c:
                    self.opened.pop()
                elif c == ")" and "case" in self.opened:
                    pass
                else:
                    self.errors += 1
                fresh, i = True, i + 1
            elif c in "<>":
                if (m := _here.match(self.src, i, end)) and not self.src.startswith("<<<", i):
                    here.append(m[2])
                    i = m.end()
                else:
                    i += 1
            else:
                stop = max(self.word_end(i, end), i + 1)
                word = self.src[i:stop]
                if fresh and word in ("if", "case", "while", "until", "for", "select"):
                    self.opened.append("loop" if word not in ("if", "case") else word)
                elif fresh and word in ("fi", "esac", "done"):
                    want = {"fi": "if", "esac": "case", "done": "loop"}[word]
                    if want in self.opened:
                        while self.opened.pop() != want:
                            self.errors += 1
                    else:
                        self.errors += 1
                fresh, i = word in BEFORE_COMMAND or (word.startswith("-") and fresh), stop
