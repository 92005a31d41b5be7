"""Blocks of JavaScript, TypeScript and their JSX forms."""

from __future__ import annotations

import re

from .common import Scanner, Token
from .markup import elements

#: Fixed: method names that frameworks call.
LIFECYCLE = set(
    "componentDidMount componentDidUpdate componentWillUnmount componentDidCatch getDerivedStateFromProps getSnapshotBeforeUpdate "
    "connectedCallback disconnectedCallback updated willUpdate firstUpdated createEffect onCleanup onMount createSignal createMemo createComputed "
    "mounted beforeMount beforeUpdate beforeUnmount unmounted".split()
)
MODIFIERS = set("static async get set public private protected readonly abstract override declare accessor".split())
#: Words after which an operand follows, so that a slash begins a regular expression and `<` an element.
OPERAND_NEXT = set("return case typeof instanceof in of new do else yield await delete void throw default export extends".split())
_word = r"[A-Za-z_$#\x80-\xff][A-Za-z0-9_$\x80-\xff]*"
_lex = re.compile(
    rf"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>{_word})|(?P<number>\d[\w.]*|\.\d[\w]*)"
    r"|(?P<text>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<mark>=>|\.\.\.|\?\.|[-+*/%&|^!=<>?:]=+|\+\+|--|&&|\|\||\?\?|[\s\S])"
)
_regex = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_tag = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*|(?=>))")
_close = re.compile(r"</\s*([\w$.:-]*)\s*>")


class EcmaScanner(Scanner):
    def __init__(self, src: str, language: str) -> None:
        super().__init__(src)
        self.language = language
        self.jsx = language in ("tsx", "jsx", "js")

    # -- tokens --------------------------------------------------------------------------

    def lex(self, at: int, end: int) -> list[Token]:
        out: list[Token] = []
        while at < end:
            c, last = self.src[at], next((t for t in reversed(out) if t.type != "comment"), None)
            operand = last is None or (last.type == "mark" and last.text not in (")", "]", "}", "++", "--")) or (last.type == "word" and last.text in OPERAND_NEXT)
            if c == "`":
                stop, holes = self.template(at, end)
                out.append(Token("template", at, stop, self.src[at:stop], value=holes))
            elif c == "<" and self.jsx and (operand or last.text == "}") and (m := _tag.match(self.src, at, end)) and (found := self.element(at, end)) is not None:
                stop, parts = found
                out.append(Token("element", at, stop, m[0][1:], value=parts))
            elif c == "/" and operand and self.src[at : at + 2] not in ("//", "/*") and (m := _regex.match(self.src, at, end)):
                stop = m.end()
                out.append(Token("regex", at, stop, m[0]))
            else:
                m = _lex.match(self.src, at, end)
                stop = m.end()
                if m.lastgroup != "space":
                    if m.lastgroup == "text" and (len(m[0]) < 2 or m[0][-1] != m[0][0]):
                        self.errors += 1
                    if m.lastgroup == "mark" and m[0] in "@\\" and not re.match(r"@[A-Za-z_$]", self.src[at : at + 2]):
                        self.errors += 1
                    out.append(Token(m.lastgroup, at, stop, m[0]))
            at = stop
        return self.pair(out)

    def template(self, at: int, end: int) -> tuple[int, list[tuple[int, int]]]:
        holes, i = [], at + 1
        while i < end:
            if self.src[i] == "\\":
                i += 2
            elif self.src[i] == "`":
                return i + 1, holes
            elif self.src.startswith("${", i):
                stop = self.code_end(i + 2, end)
                holes.append((i + 2, stop - 1))
                i = stop
            else:
                i += 1
        self.errors += 1
        return end, holes

    def code_end(self, at: int, end: int) -> int:
        """Index after the brace that closes code beginning at `at`."""
        depth, i = 1, at
        while i < end:
            c = self.src[i]
            if c == "`":
                i = self.template(i, end)[0]
                continue
            m = _lex.match(self.src, i, end)
            if m.lastgroup == "mark":
                depth += (c == "{") - (c == "}")
                if not depth:
                    return i + 1
            i = m.end()
        return end

    def element(self, at: int, end: int) -> tuple[int, list] | None:
        """(index after a JSX element, its code holes and child elements in order), or None if it isn't one."""
        m = _tag.match(self.src, at, end)
        i, parts = m.end(), []
        while i < end:  # attributes
            c = self.src[i]
            if c == "{":
                stop = self.code_end(i + 1, end)
                parts.append((i + 1, stop - 1))
                i = stop
            elif c in "\"'":
                i = (self.src.find(c, i + 1, end) + 1) or end
            elif self.src.startswith("/>", i):
                return i + 2, parts
            elif c == ">":
                i += 1
                break
            elif c in ";)":
                return None
            else:
                i += 1
        while i < end:  # children
            if self.src[i] == "{":
                stop = self.code_end(i + 1, end)
                parts.append((i + 1, stop - 1))
                i = stop
            elif m2 := _close.match(self.src, i, end):
                return (m2.end(), parts) if m2[1] == m[0][1:] else None
            elif self.src[i] == "<" and _tag.match(self.src, i, end):
                inner = self.element(i, end)
                if inner is None:
                    return None
                parts.append(Token("element", i, inner[0], _tag.match(self.src, i)[0][1:], value=inner[1]))
                i = inner[0]
            else:
                i += 1
        return None

    # -- walk ----------------------------------------------------------------------------

    def walk(self) -> None:
        self.code(0, len(self.src), "", False)

    def code(self, at: int, end: int, parent: str, inner: bool) -> None:
        tokens = self.lex(at, end)
        self.tokens(tokens, 0, len(tokens), parent, inner, "block")

    def jsx_blocks(self, t: Token, parent: str, inner: bool) -> None:
        self.add("jsx", t.text or "Fragment", t.start, t.end)
        for part in t.value:
            if isinstance(part, Token):
                self.jsx_blocks(part, parent, inner)
            else:
                self.code(part[0], part[1], parent, inner)

    def template_blocks(self, ts: list[Token], i: int, parent: str, inner: bool) -> None:
        t = ts[i]
        if i and ts[i - 1].text == "html" and (i < 2 or ts[i - 2].text not in (".", "?.")):
            body = self.src[t.start + 1 : t.end - 1]
            for s, e, name in elements(body):
                self.add("template", name, t.start + 1 + s, t.start + 1 + e)
        for hole in t.value:
            self.code(hole[0], hole[1], parent, inner)

    def statement_start(self, ts: list[Token], i: int, lo: int) -> bool:
        k = i - 1
        while k >= lo and ts[k].type == "comment":
            k -= 1
        if k < lo:
            return True
        p = ts[k]
        return p.text in (";", "{", "}", "else", "do") or p.text in (")", ":") or (p.line < ts[i].line and not (p.type == "mark" and p.text not in (")", "]", "}")) and p.text not in OPERAND_NEXT)

    def statement_end(self, ts: list[Token], i: int, hi: int) -> int:
        """Index after the last token of a statement that begins before i; brackets are passed over whole."""
        while i < hi:
            t = ts[i]
            if t.text == ";" and t.type == "mark":
                return i + 1
            if t.type == "mark" and t.text in ")]}":
                return i
            i = t.mate + 1 if t.mate > i else i + 1
            if i < hi and ts[i].line > self.line(ts[i - 1].end - 1):
                p, n = ts[i - 1], ts[i]
                goes_on = (p.type == "mark" and p.text not in (")", "]", "}", "++", "--", ";")) or (p.type == "word" and p.text in OPERAND_NEXT)
                goes_on |= n.type == "mark" and n.text not in ("{", "@", "}", "#", "++", "--", "[") or n.text in ("instanceof", "in", "extends", "as")
                if not goes_on and p.text != ";":
                    return i
        return i

    def body_of(self, ts: list[Token], i: int, hi: int) -> int:
        """Index of the brace that opens a body after a parameter list; -1 if there is none."""
        while i < hi:
            t = ts[i]
            if t.text == "{" and ts[i - 1].text not in (":", "|", "&", "<", ",", "=>"):
                return i
            if t.text in (";", "=", "}") or (t.line > ts[i - 1].line and t.type == "word"):
                return -1
            i = t.mate + 1 if t.mate > i else i + 1
        return -1

    def tokens(self, ts: list[Token], i: int, hi: int, parent: str, inner: bool, where: str) -> None:
        lo = i
        while i < hi:
            i = self.one(ts, i, lo, hi, parent, inner, where)

    def one(self, ts: list[Token], i: int, lo: int, hi: int, parent: str, inner: bool, where: str) -> int:
        t = ts[i]
        if t.type == "comment":
            self.add("comment", "", t.start, t.end)
        elif t.type == "element":
            self.jsx_blocks(t, parent, inner)
        elif t.type == "template":
            self.template_blocks(ts, i, parent, inner)
        elif where == "class" or (where == "object" and (i == lo or ts[i - 1].text == ",")):
            return self.member(ts, i, lo, hi, parent, inner, where)
        elif t.type == "word" and not (i and ts[i - 1].text in (".", "?.")):
            if (end := self.word(ts, i, lo, hi, parent, inner)) > i:
                return end
        if t.type == "mark" and t.text in "([{" and t.mate > i:
            if t.text == "(" and (end := self.arrow(ts, i, i, lo, hi, parent, inner)) > i:
                return end
            kind = "block"
            if t.text == "{" and i > lo:
                p = ts[i - 1]
                kind = "object" if (p.type == "mark" and p.text not in (")", ";", "{", "}", "=>", ":")) or p.text in ("return", "default", "await", "yield") else "block"
                kind = "object" if p.text == ":" and where == "object" else kind
            elif t.text == "{" and where == "value":
                kind = "object"
            if t.text in "([" and t.mate > i + 1:
                self.value_at = ts[i + 1].start
            self.tokens(ts, i + 1, t.mate, parent, inner, kind)
            return t.mate + 1
        return i + 1

    def word(self, ts: list[Token], i: int, lo: int, hi: int, parent: str, inner: bool) -> int:
        """Handle a construct that begins with the word at i; its end, or i if there is none."""
        t, at_start = ts[i], ts[i].start != self.value_at and self.statement_start(ts, i, lo)
        nxt = ts[i + 1] if i + 1 < hi else None
        if at_start and t.text == "import" and nxt and nxt.text not in ("(", "."):
            end = self.statement_end(ts, i + 1, hi)
            self.add("import", self.import_name(ts[i + 1 : end]), t.start, ts[end - 1].end)
            return end
        if at_start and t.text == "export":
            return self.export(ts, i, hi, parent, inner)
        if at_start and (end := self.declaration(ts, i, i, hi, parent, inner)) > i:
            return end
        if t.text == "function" or (t.text == "async" and nxt and nxt.text == "function"):
            return self.function(ts, i, i, hi, parent, inner, False)
        if t.text == "class" and (body := self.class_body(ts, i, hi)) > 0:
            self.tokens(ts, body + 1, ts[body].mate, parent, inner, "class")
            return ts[body].mate + 1
        k = i + 1 if t.text == "async" and nxt and (nxt.text == "(" or nxt.type == "word") else i
        return self.arrow(ts, i, k, lo, hi, parent, inner)

    def declaration(self, ts: list[Token], i: int, start: int, hi: int, parent: str, inner: bool) -> int:
        """A declaration whose keyword is at i and whose block begins with the token at start."""
        t, first = ts[i], ts[start].start
        nxt = ts[i + 1] if i + 1 < hi else None
        if nxt is None:
            return i
        if t.text == "declare" or (t.text == "abstract" and nxt.text == "class"):
            got = self.declaration(ts, i + 1, start, hi, parent, inner)
            return got if got > i + 1 else i
        if t.text == "function" or (t.text == "async" and nxt.text == "function"):
            return self.function(ts, i, start, hi, parent, inner, True)
        if t.text == "class" and (body := self.class_body(ts, i, hi)) > 0:
            name = nxt.text if nxt.type == "word" and nxt.text not in ("extends", "implements") else ""
            end = ts[body].mate
            b = self.add("class", name, first, ts[end].end, parent)
            self.tokens(ts, i + 1, body, b.id, inner, "block")
            self.tokens(ts, body + 1, end, b.id, inner, "class")
            return end + 1
        if t.text in ("interface", "enum") and nxt.type == "word" or (t.text == "const" and nxt.text == "enum"):
            k = i + 1 + (nxt.text == "enum")
            body = next((j for j in range(k, hi) if ts[j].text == "{" and ts[j].mate > j), -1)
            if body > 0:
                end = ts[body].mate
                b = self.add("interface" if t.text == "interface" else "enum", ts[k].text, first, ts[end].end, parent)
                self.tokens(ts, body + 1, end, b.id, inner, "types")
                return end + 1
        if t.text == "type" and nxt.type == "word" and i + 2 < hi and ts[i + 2].text in ("=", "<"):
            end = self.statement_end(ts, i + 1, hi)
            b = self.add("type_alias", nxt.text, first, ts[end - 1].end, parent)
            self.tokens(ts, i + 3, end, b.id, inner, "types")
            return end
        if t.text in ("const", "let", "var") and (nxt.type == "word" or nxt.text in "[{"):
            return self.variables(ts, i, start, hi, parent, inner)
        return i

    def function(self, ts: list[Token], i: int, start: int, hi: int, parent: str, inner: bool, declared: bool) -> int:
        k = i + 1 + (ts[i].text == "async")
        k += k < hi and ts[k].text == "*"
        name = ts[k].text if k < hi and ts[k].type == "word" else ""
        params = next((j for j in range(k, hi) if ts[j].text == "("), -1)
        if params < 0 or ts[params].mate < 0:
            return i + 1
        body = self.body_of(ts, ts[params].mate + 1, hi)
        if body < 0 or ts[body].mate < 0:
            return ts[params].mate + 1
        end = ts[body].mate
        if declared or not self.is_value:
            parent = self.add("function", name or ("" if declared else "<anonymous>"), ts[start].start, ts[end].end, parent).id
        self.is_value = False
        self.tokens(ts, params + 1, ts[params].mate, parent, True, "block")
        self.tokens(ts, body + 1, end, parent, True, "block")
        return end + 1

    value_at = -1  # offset of the value of a declarator or member, which begins an expression and no statement
    is_value = False  # whether the function or arrow met next is the value of a declarator, which is its block

    def arrow(self, ts: list[Token], i: int, k: int, lo: int, hi: int, parent: str, inner: bool) -> int:
        """An arrow function that begins at i with its parameters at k; its end, or i if there is none."""
        to = ts[k].mate + 1 if ts[k].text == "(" and ts[k].mate > k else k + 1
        if ts[k].text == "(" and to < hi and ts[to].text == ":":
            j = to + 1
            while j < hi and ts[j].text not in ("=>", ";", ",", "=", "?"):
                j = ts[j].mate + 1 if ts[j].mate > j else j + 1
            to = j
        if to >= hi or ts[to].text != "=>" or (ts[k].type != "word" and ts[k].text != "("):
            return i
        body = to + 1
        if body < hi and ts[body].text == "{" and ts[body].mate > body:
            end = ts[body].mate + 1
        else:
            end = body
            while end < hi and ts[end].text not in (",", ";", ")", "]", "}"):
                end = ts[end].mate + 1 if ts[end].mate > end else end + 1
                if end < hi and ts[end].line > self.line(ts[end - 1].end - 1) and ts[end].type == "word" and ts[end - 1].type != "mark":
                    break
        if not self.is_value and not inner and end > body:
            parent = self.add("arrow_function", "", ts[i].start, ts[end - 1].end, parent).id
        self.is_value = False
        if ts[k].text == "(":
            self.tokens(ts, k + 1, ts[k].mate, parent, True, "block")
        if ts[body : body + 1] and ts[body].text == "{" and ts[body].mate > body:
            self.tokens(ts, body + 1, ts[body].mate, parent, True, "block")
        else:
            self.tokens(ts, body, end, parent, True, "block")
        return end

    def class_body(self, ts: list[Token], i: int, hi: int) -> int:
        j = i + 1
        while j < hi and ts[j].text not in ("{", ";"):
            j = ts[j].mate + 1 if ts[j].mate > j else j + 1
        return j if j < hi and ts[j].text == "{" and ts[j].mate > j else -1

    def variables(self, ts: list[Token], i: int, start: int, hi: int, parent: str, inner: bool) -> int:
        end = self.statement_end(ts, i + 1, hi)
        last = end - 1 if ts[end - 1].text == ";" else end
        parts, at, j = [], i + 1, i + 1
        while j < last:
            if ts[j].text == "," and ts[j].type == "mark":
                parts.append((at, j))
                at = j + 1
            if ts[j].text == "<" and ts[j - 1].text == "=":  # type parameters of an arrow function
                j = next((k for k in range(j, last) if ts[k].text == ">"), j)
            j = ts[j].mate + 1 if ts[j].mate > j else j + 1
        parts.append((at, last))
        parts = [(a, b) for a, b in parts if a < b]
        for a, b in parts:
            eq = next((j for j in self.flat(ts, a, b) if ts[j].text == "="), b)
            self.value_at = ts[eq + 1].start if eq + 1 < b else -1
            name = next((ts[j].text for j in range(a, eq) if ts[j].type == "word"), "")
            if inner:
                self.is_value = self.value_kind(ts, eq + 1, b) != ""
                self.tokens(ts, eq + 1, b, parent, True, "block")
                self.is_value = False
                continue
            kind = self.value_kind(ts, eq + 1, b) or ("constant" if ts[i].text == "const" else "variable")
            span = (ts[start].start, ts[end - 1].end) if len(parts) == 1 else (ts[a].start, ts[b - 1].end)
            block = self.add(kind, name, *span, parent)
            self.tokens(ts, a + 1, eq, block.id, inner, "types")
            self.value_at = ts[eq + 1].start if eq + 1 < b else -1
            self.is_value = kind in ("arrow_function", "function")
            self.tokens(ts, eq + 1, b, block.id, inner, "block" if eq + 1 < b and ts[eq + 1].text != "{" else "value")
            self.is_value = False
        return end

    @staticmethod
    def flat(ts: list[Token], a: int, b: int):
        while a < b:
            yield a
            a = ts[a].mate + 1 if ts[a].mate > a else a + 1

    def value_kind(self, ts: list[Token], a: int, b: int) -> str:
        if a >= b:
            return ""
        if ts[a].text == "function" or (ts[a].text == "async" and a + 1 < b and ts[a + 1].text == "function"):
            return "function"
        k = a + 1 if ts[a].text == "async" else a
        if ts[k : k + 1] and ts[k].text == "<":
            k = next((j + 1 for j in range(k, b) if ts[j].text == ">"), k)
        arrow = next((j for j in self.flat(ts, k, b) if ts[j].text == "=>"), -1)
        simple = k < b and (ts[k].text == "(" or (ts[k].type == "word" and arrow == k + 1))
        return "arrow_function" if arrow > 0 and simple else ""

    def export(self, ts: list[Token], i: int, hi: int, parent: str, inner: bool) -> int:
        k = i + 1
        if k >= hi:
            return k
        if ts[k].text == "type" and k + 1 < hi and ts[k + 1].text in ("{", "*"):
            k += 1
        if ts[k].text in ("{", "*"):
            end = self.statement_end(ts, k, hi)
            if ts[k].text == "{" and ts[k].mate > k:
                name = ", ".join(self.specifiers(ts[k + 1 : ts[k].mate]))
            else:
                name = next((t.text[1:-1] for t in ts[k:end] if t.type == "text"), "")
            self.add("export", name, ts[i].start, ts[end - 1].end, parent)
            return end
        if ts[k].text == "default":
            end = self.declaration(ts, k + 1, i, hi, parent, inner) if k + 1 < hi and ts[k + 1].text in ("function", "async", "class", "abstract", "interface") else k + 1
            return max(end, k + 1)
        end = self.declaration(ts, k, i, hi, parent, inner)
        return end if end > k else k

    @staticmethod
    def specifiers(ts: list[Token]) -> list[str]:
        out, fresh = [], True
        for t in ts:
            if t.text == ",":
                fresh = True
            elif t.type == "word" and fresh and t.text != "type":
                out.append(t.text)
                fresh = False
        return out

    def import_name(self, ts: list[Token]) -> str:
        brace = next((k for k, t in enumerate(ts) if t.text == "{"), -1)
        if brace >= 0:
            stop = next((k for k, t in enumerate(ts) if t.text == "}"), len(ts))
            names = self.specifiers(ts[brace + 1 : stop])
            if names:
                return ", ".join(names)
        for k, t in enumerate(ts):
            if t.text == "as" and k and ts[k - 1].text == "*" and k + 1 < len(ts):
                return ts[k + 1].text
        if ts and ts[0].type == "word" and ts[0].text not in ("type",):
            return ts[0].text
        if len(ts) > 1 and ts[0].text == "type" and ts[1].type == "word":
            return ts[1].text
        return next((t.text[1:-1] for t in ts if t.type == "text"), "")

    def member(self, ts: list[Token], i: int, lo: int, hi: int, parent: str, inner: bool, where: str) -> int:
        """A class or object member that begins at i."""
        if ts[i].text in (";", ","):
            return i + 1
        if ts[i].text == "@":
            k = i + 2
            while k < hi and ts[k].text == ".":
                k += 2
            return ts[k].mate + 1 if k < hi and ts[k].text == "(" and ts[k].mate > k else k
        k = i
        while k < hi and ((ts[k].text in MODIFIERS and k + 1 < hi and ts[k + 1].text not in ("(", "=", ";", ":", ",", "?", "!", "}")) or ts[k].text == "*"):
            k += 1
        if k < hi and ts[k].text == "[" and ts[k].mate > k:
            name, after = "", ts[k].mate + 1
        elif k < hi and ts[k].type in ("word", "text", "number"):
            name, after = (ts[k].text if ts[k].type == "word" and not ts[k].text.startswith("#") else ""), k + 1
        elif ts[i].text == "{" and ts[i].mate > i:  # static block
            self.tokens(ts, i + 1, ts[i].mate, parent, inner, "block")
            return ts[i].mate + 1
        else:
            return self.one(ts, i, lo, hi, parent, inner, "block")
        while after < hi and ts[after].text in ("?", "!"):
            after += 1
        if after < hi and ts[after].text == "<":
            depth = 0
            while after < hi:
                depth += ts[after].text.count("<") - ts[after].text.count(">")
                after += 1
                if depth <= 0:
                    break
        if after < hi and ts[after].text == "(" and ts[after].mate > after:
            body = self.body_of(ts, ts[after].mate + 1, hi)
            if body > 0 and ts[body].mate > body:
                end = ts[body].mate
                kind = "lifecycle" if name in LIFECYCLE else "object_method" if where == "object" else "method"
                b = self.add(kind, name, ts[i].start, ts[end].end, parent)
                self.tokens(ts, after + 1, ts[after].mate, b.id, True, "block")
                self.tokens(ts, body + 1, end, b.id, True, "block")
                return end + 1
        if where == "object":
            end = next((j for j in self.flat(ts, i, hi) if ts[j].text == ","), hi)
        else:
            end = self.statement_end(ts, after, hi)
        value = after + 1 if after < hi and ts[after].text in (":", "=") else after
        for j in range(i, min(value, end)):
            if ts[j].type == "comment":
                self.add("comment", "", ts[j].start, ts[j].end)
        if where == "object" and value < end and ts[value].text == "{" and ts[value].mate > value:
            self.tokens(ts, value + 1, ts[value].mate, parent, inner, "object")
            value = ts[value].mate + 1
        self.value_at = ts[value].start if value < end else -1
        self.tokens(ts, value, end, parent, inner, "block")
        return max(end, i + 1)


__all__ = ["EcmaScanner", "LIFECYCLE"]
