"""Blocks of Go."""

from __future__ import annotations

import re

from .common import Scanner, Token

_lex = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<number>\d[\w.]*)"
    r"|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?)|(?P<mark>:=|<-|\.\.\.|[\s\S])"
)


class GoScanner(Scanner):
    language = "go"

    def lex(self) -> list[Token]:
        out = []
        for m in _lex.finditer(self.src):
            if m.lastgroup == "space":
                continue
            if m.lastgroup == "text" and (len(m[0]) < 2 or m[0][-1] != m[0][0]):
                self.errors += 1
            if m[0] in ("@", "#", "$", "?", "\\"):
                self.errors += 1
            out.append(Token(m.lastgroup, m.start(), m.end(), m[0]))
        return self.pair(out)

    def walk(self) -> None:
        ts, i = self.lex(), 0
        while i < len(ts):
            t = ts[i]
            if t.type == "comment":
                self.add("comment", "", t.start, t.end)
                i += 1
            elif t.text == "func":
                i = self.function(ts, i)
            elif t.text in ("type", "var", "const", "import"):
                i = self.declarations(ts, i)
            else:
                i = self.inside(ts, i, i + 1, "") if t.mate < i else self.inside(ts, i, t.mate + 1, "")

    def inside(self, ts: list[Token], i: int, end: int, parent: str) -> int:
        for t in ts[i:end]:
            if t.type == "comment":
                self.add("comment", "", t.start, t.end)
        return max(end, i + 1)

    def end_of(self, ts: list[Token], i: int) -> int:
        """Index after the last token of a declaration: lines go on inside brackets and after operators."""
        while i < len(ts):
            i = ts[i].mate + 1 if ts[i].mate > i else i + 1
            if i < len(ts) and (ts[i].text == ";" or (ts[i].line > self.line(ts[i - 1].end - 1) and not (ts[i - 1].type == "mark" and ts[i - 1].text not in ")]}"))):
                return i
            if i < len(ts) and ts[i].text == ")" and ts[i].mate < i:
                return i
        return i

    def function(self, ts: list[Token], i: int) -> int:
        k = i + 1
        method = k < len(ts) and ts[k].text == "(" and ts[k].mate > k
        k = ts[k].mate + 1 if method else k
        name = ts[k].text if k < len(ts) and ts[k].type == "word" else ""
        end = self.end_of(ts, k)
        self.add("method" if method else "function", name, ts[i].start, ts[end - 1].end)
        return self.inside(ts, k, end, "")

    def declarations(self, ts: list[Token], i: int) -> int:
        word, k = ts[i].text, i + 1
        if k >= len(ts):
            return k
        if word == "import":
            end = self.end_of(ts, i)
            name = "" if ts[k].text == "(" else next((t.text for t in ts[k:end] if t.type == "text"), "")
            self.add("import", name, ts[i].start, ts[end - 1].end)
            return self.inside(ts, k, end, "")
        if ts[k].text != "(" or ts[k].mate < k:
            end = self.end_of(ts, i)
            self.spec(ts, word, k, end, ts[i].start)
            return end
        specs, j = [], k + 1
        while j < ts[k].mate:
            if ts[j].type == "comment" or ts[j].text == ";":
                specs.append((j, j + 1))
                j += 1
                continue
            end = min(self.end_of(ts, j), ts[k].mate)
            while ts[end - 1].type == "comment" and end - 1 > j:
                end -= 1
            specs.append((j, end))
            j = max(end, j + 1)
        real = [s for s in specs if ts[s[0]].type == "word"]
        for a, b in specs:
            if ts[a].type == "comment":
                self.inside(ts, a, b, "")
            elif ts[a].type == "word" and len(real) == 1:
                self.spec(ts, word, a, b, ts[i].start, ts[ts[k].mate].end)
            elif ts[a].type == "word":
                self.spec(ts, word, a, b, ts[a].start)
        return ts[k].mate + 1

    def spec(self, ts: list[Token], word: str, a: int, b: int, start: int, end: int = 0) -> None:
        while ts[b - 1].type == "comment" and b - 1 > a:
            b -= 1
        kind = {"var": "variable", "const": "constant"}.get(word, "type_alias")
        if kind == "type_alias" and a + 1 < b:
            k = a + 1
            if ts[k].text == "[" and ts[k].mate > k and ts[k].mate > k + 1:  # type parameters
                k = ts[k].mate + 1
            shape = ts[k].text if k < b else ""
            kind = {"struct": "class", "interface": "interface"}.get(shape, kind)
        self.add(kind, ts[a].text, start, end or ts[b - 1].end)
        self.inside(ts, a, b, "")
