"""Blocks of C and C++."""

from __future__ import annotations

import re
from collections import defaultdict

from ..kernels.blocks import Block, Document
from .common import Scanner, Token

_lex = re.compile(
    r"(?P<space>(?:\s|\\\r?\n)+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>(?:u8|u|U|L)?R\"(?P<d>[^()\\\s]*)\([\s\S]*?\)(?P=d)\"\w*"
    r"|(?:u8|u|U|L)?(?:\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])+'?)\w*)|(?P<word>~?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<number>\d(?:[\w.]|'\w)*|\.\d[\w.]*)"
    r"|(?P<mark>::|->|<<=|>>=|<=>|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|\.\.\.|[\s\S])"
)
_directive = re.compile(r"[ \t]*#[ \t]*(\w+)(?:[^\n\\]|\\\r?\n|\\)*")
_define = re.compile(r"#[ \t]*define[ \t]+(\w+)(\()?")
TYPES = ("class", "struct", "union", "enum")
NOT_NAMES = set("if for while switch return sizeof decltype alignas noexcept throw requires __attribute__ __declspec static_assert alignof typeof".split())
QUALIFIERS = set("const constexpr constinit volatile static extern inline register mutable thread_local virtual explicit friend typename".split())


class CScanner(Scanner):
    def __init__(self, src: str, language: str, macros: bool) -> None:
        super().__init__(src)
        self.language, self.macros = language, macros
        self.classes: dict[str, str] = {}  # qualified class name -> id
        self.bare: dict[str, set[str]] = defaultdict(set)
        self.late: list[tuple[Block, str, str]] = []  # definitions outside their class: block, class, name of a method

    def lex(self) -> list[Token]:
        out, at, fresh = [], 0, True
        while at < len(self.src):
            m = _directive.match(self.src, at) if fresh else None
            if m:
                start = self.src.index("#", at)
                out.append(Token("directive", start, m.end(), self.src[start : m.end()].rstrip("\r\n")))
                at, fresh = m.end(), True
                continue
            m = _lex.match(self.src, at)
            if m.lastgroup == "space":
                fresh = fresh or "\n" in m[0]
            else:
                fresh = False
                kind = "text" if m["text"] else m.lastgroup
                if kind == "text" and m[0].rstrip("_0123456789" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")[-1:] not in ("'", '"'):
                    self.errors += 1
                if kind == "mark" and m[0] in ("@", "`", "\\", "#"):
                    self.errors += 1
                out.append(Token(kind, m.start(), m.end(), m[0]))
            at = m.end()
        return self.pair(out)

    def walk(self) -> None:
        self.ts = self.lex()
        self.scope(0, len(self.ts), "", (), "file")
        for b, path, member in self.late:
            bare = self.bare[path.split("::")[-1]]
            owner = self.classes.get(path) or (next(iter(bare)) if len(bare) == 1 else "")
            if owner:
                old = b.id
                b.parent = owner
                if member:
                    b.kind, b.name = "method", member
                b.id = f"{b.kind}:{b.name}:{b.start}"
                for x in self.blocks:
                    if x.parent == old:
                        x.parent = b.id
        by_id = {b.id: b for b in self.blocks}
        for b in self.blocks:
            path, up = [], by_id.get(b.parent)
            while up is not None:
                if up.kind in ("namespace", "class") and up.name:
                    path.append(up.name)
                up = by_id.get(up.parent)
            b.scope = "::".join(reversed(path)) if b.kind != "comment" else ""

    # -- one level of declarations -------------------------------------------------------

    def scope(self, i: int, hi: int, parent: str, path: tuple[str, ...], where: str) -> None:
        while i < hi:
            t = self.ts[i]
            if t.type == "comment":
                self.add("comment", "", t.start, t.end)
                i += 1
            elif t.type == "directive":
                self.directive(t, parent)
                i += 1
            elif t.text in ("public", "private", "protected") and i + 1 < hi and self.ts[i + 1].text == ":":
                i += 2
            elif t.text == ";" or (t.text == "}" and t.mate < 0):
                i += 1
            else:
                i = max(self.item(i, hi, parent, path, where), i + 1)

    def directive(self, t: Token, parent: str) -> None:
        end = t.start + len(t.text)
        if re.match(r"#[ \t]*include", t.text):
            name = re.sub(r"#[ \t]*include[ \t]*", "", t.text).split("//")[0].strip()
            self.add("import", name, t.start, end, parent)
        elif m := _define.match(t.text):
            kind = "constant" if not m[2] else "macro_function" if self.macros else "function"
            self.add(kind, m[1], t.start, end, parent)
        elif t.text.startswith("#define"):
            self.errors += 1

    def comments(self, a: int, b: int) -> None:
        for t in self.ts[a:b]:
            if t.type == "comment":
                self.add("comment", "", t.start, t.end)
            elif t.type == "directive":
                self.directive(t, "")

    def angle_end(self, i: int, hi: int) -> int:
        """Index after the template list that begins with < at i."""
        depth = 0
        while i < hi:
            x = self.ts[i].text
            depth += (x == "<") - (x == ">")
            i = self.ts[i].mate + 1 if self.ts[i].mate > i else i + 1
            if depth <= 0:
                return i
        return hi

    def item(self, i: int, hi: int, parent: str, path: tuple[str, ...], where: str) -> int:
        """One declaration, definition or namespace beginning at i."""
        ts, start = self.ts, i
        while i < hi and ts[i].text == "template" and i + 1 < hi and ts[i + 1].text == "<":
            i = self.angle_end(i + 1, hi)
            if i < hi and ts[i].text == "requires":
                while i < hi and ts[i].text not in (*TYPES, "auto", "void", "T", "template", "concept"):
                    i = ts[i].mate + 1 if ts[i].mate > i else i + 1
        if i >= hi:
            return hi
        word = ts[i].text
        if word == "inline" and i + 1 < hi and ts[i + 1].text == "namespace":
            i, word = i + 1, "namespace"
        if word == "namespace" and "=" not in [t.text for t in ts[i : i + 3]]:
            body = next((j for j in range(i, hi) if ts[j].text in ("{", ";")), hi)
            if body < hi and ts[body].text == "{" and ts[body].mate > body:
                name = "".join(t.text for t in ts[i + 1 : body] if t.type != "comment")
                b = self.add("namespace", name, ts[start].start, ts[ts[body].mate].end, parent)
                self.scope(body + 1, ts[body].mate, b.id, (*path, name) if name else path, "file")
                return ts[body].mate + 1
        if word == "extern" and i + 2 < hi and ts[i + 1].type == "text" and ts[i + 2].text == "{" and ts[i + 2].mate > i:
            self.scope(i + 3, ts[i + 2].mate, parent, path, where)
            return ts[i + 2].mate + 1
        end, body = self.extent(i, hi)
        semi = ts[end - 1].text == ";"
        if not semi and body < 0 and end >= hi:
            self.errors += 1
        first, last = ts[start].start, ts[end - 1].end
        if word == "concept":
            self.add("concept", ts[i + 1].text if i + 1 < end else "", first, last, parent)
        elif word == "using" and any(t.text == "=" for t in ts[i:end]):
            self.add("type_alias", ts[i + 1].text, first, last, parent)
        elif word in ("using", "static_assert"):
            pass
        elif word == "typedef":
            self.typedef(i, end, parent)
        elif (k := self.type_keyword(i, end)) >= 0 and self.own_body(k, end) >= 0:
            return self.type_definition(start, i, k, end, parent, path, where)
        elif (k := self.type_keyword(i, end)) >= 0 and all(t.type == "word" or t.text in ("::", ";") for t in ts[k:end]) and sum(t.type == "word" for t in ts[k + 1 : end]) == 1:
            pass  # a type named without a body
        elif (call := self.call(i, body if body >= 0 else end)) >= 0 and not any(t.text == "=" and ts[j - 1].text != "operator" for j, t in enumerate(ts[i:call], i)):
            self.function(start, i, call, body, end, parent, path, where)
            return end
        elif where != "class" or any(t.text == "[" for t in ts[i:end]):
            self.objects(start, i, end, parent, where)
        self.comments(i, end)
        return end

    def extent(self, i: int, hi: int) -> tuple[int, int]:
        """(index after a declaration, index of the brace of a function body or -1)."""
        ts, j, seen_call, assigned = self.ts, i, False, False
        while j < hi:
            t = ts[j]
            if t.text == ";":
                return j + 1, -1
            if t.type == "directive" and j > i:
                return j, -1
            if t.text == "=" and not (j and ts[j - 1].text == "operator"):
                assigned = True
            if t.text == "(" and t.mate > j:
                seen_call = True
            if t.text == "{" and t.mate > j:
                p = ts[j - 1]
                head = [x.text for x in ts[i:j]]
                if seen_call and not assigned and not (set(head) & set(TYPES) and "(" not in head) and not (p.type == "word" and self.in_initializers(i, j)):
                    return t.mate + 1, j
                if not assigned and not seen_call and not set(head) & set(TYPES) and "concept" not in head:
                    k = t.mate + 1
                    return (k + 1, -1) if k < hi and ts[k].text == ";" else (k, -1)
                if "enum" in head or set(head) & set(TYPES):
                    k = t.mate + 1
                    while k < hi and ts[k].text != ";" and ts[k].line <= self.line(ts[k - 1].end - 1):
                        k = ts[k].mate + 1 if ts[k].mate > k else k + 1
                    if k < hi and ts[k].text == ";":
                        return k + 1, -1
                    return t.mate + 1, -1
            j = t.mate + 1 if t.mate > j else j + 1
        return hi, -1

    def in_initializers(self, i: int, j: int) -> bool:
        """Whether the brace at j initializes a member in a constructor's list."""
        depth_colon = any(self.ts[k].text == ":" and self.ts[k - 1].text in (")", "noexcept") for k in range(i + 1, j))
        return depth_colon and self.ts[j - 1].type == "word" and self.ts[j - 2].text in (":", ",")

    def type_keyword(self, i: int, end: int) -> int:
        j = i
        while j < end and (self.ts[j].text in QUALIFIERS or self.ts[j].type == "comment"):
            j += 1
        return j if j < end and self.ts[j].text in TYPES else -1

    def own_body(self, k: int, end: int) -> int:
        for j in range(k, end):
            if self.ts[j].text in ("=", "(", ";") and self.ts[j - 1].text not in ("alignas", "__attribute__"):
                return -1
            if self.ts[j].text == "{" and self.ts[j].mate > j:
                return j
        return -1

    def type_definition(self, start: int, i: int, k: int, end: int, parent: str, path: tuple[str, ...], where: str) -> int:
        ts = self.ts
        body = self.own_body(k, end)
        j = k + 1 + (ts[k].text == "enum" and ts[k + 1].text in ("class", "struct"))
        name = ""
        while j < body and ts[j].text not in (":", "final"):
            if ts[j].type == "word" and ts[j].text not in ("alignas", "__attribute__"):
                name = ts[j].text
            j = ts[j].mate + 1 if ts[j].mate > j else (self.angle_end(j, body) if ts[j].text == "<" else j + 1)
        close = ts[body].mate
        after = close + 1
        alone = after < len(ts) and ts[after].text == ";"
        b = self.add("enum" if ts[k].text == "enum" else "class", name, ts[start].start if alone or start == i else ts[k].start, ts[after].end if alone else ts[close].end, parent)
        if b.kind == "class":
            inner = (*path, name)
            self.classes["::".join(inner)] = b.id
            self.bare[name].add(b.id)
            self.scope(body + 1, close, b.id, inner, "class")
        else:
            self.comments(body + 1, close)
        if not alone and after < end:
            self.objects(after, after, end, parent, where)
        return max(end if not alone else after + 1, after)

    def typedef(self, i: int, end: int, parent: str) -> None:
        names, depth_names = [], []
        j = i + 1
        while j < end:
            t = self.ts[j]
            if t.text in (",", ";"):
                if depth_names:
                    names.append(depth_names[-1])
                depth_names = []
            elif t.type == "word":
                depth_names.append(t.text)
            elif t.text == "(" and t.mate > j:
                inside = [x for x in self.ts[j + 1 : t.mate]]
                if inside and inside[0].text in ("*", "&", "^"):
                    depth_names.append(next((x.text for x in inside if x.type == "word"), ""))
                    j = t.mate
                    if j + 1 < end and self.ts[j + 1].text == "(":
                        j = self.ts[j + 1].mate
            j = t.mate + 1 if t.mate > j else j + 1
        first, last = self.ts[i].start, self.ts[end - 1].end
        if len(names) <= 1:
            self.add("type_alias", names[0] if names else "", first, last, parent)
        else:
            for n in names:
                at = next(x for x in reversed(self.ts[i:end]) if x.text == n)
                self.add("type_alias", n, at.start, at.end, parent)

    def call(self, i: int, end: int) -> int:
        """Index of the bracket that opens a function's parameters; -1 if the declaration has none."""
        ts, j = self.ts, i
        while j < end:
            t = ts[j]
            if t.text == "operator":
                k = j + 1
                if k < end and ts[k].text == "(" and k + 1 < end and ts[k + 1].text == ")":
                    return k + 2 if k + 2 < end and ts[k + 2].text == "(" else -1
                while k < end and ts[k].text != "(":
                    k += 1
                return k if k < end else -1
            if t.text == "<" and j > i and ts[j - 1].type == "word":
                j = self.angle_end(j, end)
                continue
            if t.text == "(" and t.mate > j:
                p = ts[j - 1]
                inside = ts[j + 1 : t.mate]
                if p.type == "word" and p.text not in NOT_NAMES and j > i or p.text == ">":
                    if inside and inside[0].text in ("*", "&") and t.mate + 1 < end and ts[t.mate + 1].text == "(":
                        return -1  # pointer to function
                    return j
            if t.text in ("=", "{", ":") and not (t.text == ":" and False):
                return -1
            j = t.mate + 1 if t.mate > j else j + 1
        return -1

    def function(self, start: int, i: int, call: int, body: int, end: int, parent: str, path: tuple[str, ...], where: str) -> None:
        ts = self.ts
        k = call - 1
        if any(t.text == "operator" for t in ts[i:call]):
            k = next(j for j in range(call - 1, i - 1, -1) if ts[j].text == "operator")
            name = "operator" + (" " if ts[k + 1].type == "word" else "") + "".join(t.text for t in ts[k + 1 : call])
        else:
            if ts[k].text == ">":
                while k > i and ts[k].text != "<":
                    k -= 1
                k -= 1
            name = self.src[ts[k].start : ts[call - 1].end]
        scope = []
        while k - 2 >= i and ts[k - 1].text == "::":
            part = k - 2
            if ts[part].text == ">":
                while part > i and ts[part].text != "<":
                    part -= 1
                part -= 1
            scope.insert(0, ts[part].text)
            k = part
        friend = any(t.text == "friend" for t in ts[i:call])
        kind = "method" if where == "class" and not friend else "function"
        full = "::".join([*scope, name])
        up = parent if not friend else next((b.parent for b in self.blocks if b.id == parent), parent)
        b = self.add(kind, full, ts[start].start, ts[end - 1].end, up)
        if scope and body >= 0:
            self.late.append((b, "::".join([*path, *scope]), name))
        self.comments(call, end)

    def objects(self, start: int, i: int, end: int, parent: str, where: str) -> None:
        """Variables, constants and lambdas of one declaration, one block per declarator."""
        ts = self.ts
        last = end - 1 if ts[end - 1].text == ";" else end
        parts, at, j, assigned = [], i, i, False
        while j < last:
            t = ts[j]
            if t.text == ",":
                parts.append((at, j))
                at, assigned = j + 1, False
            elif t.text == "=":
                assigned = True
            if t.text == "<" and not assigned and j > i and ts[j - 1].type == "word":
                j = self.angle_end(j, last)
                continue
            j = t.mate + 1 if t.mate > j else j + 1
        parts.append((at, last))
        head = [t.text for t in ts[i : parts[0][1]]]
        for a, b in parts:
            eq = next((k for k in range(a, b) if ts[k].text in ("=", "{", "[", "(") and (ts[k].text != "(" or ts[k + 1].text not in ("*", "&"))), b)
            words = [k for k in range(a, eq) if ts[k].type == "word" and ts[k].text not in QUALIFIERS]
            if not words:
                continue
            value = next((k for k in range(a, b) if ts[k].text == "="), b) + 1
            is_lambda = value < b and ts[value].text == "[" and ts[value].mate > value and ts[value].mate + 1 < b and ts[ts[value].mate + 1].text in ("(", "{", "<", "mutable")
            if where == "class" and not is_lambda:
                continue
            if a == i and len(words) < 2 and start == i and eq == b:
                continue  # a type or macro alone
            pointer = any(ts[k].text == "*" for k in range(a if a != i else i, eq))
            const = "constexpr" in head or ("const" in head and not pointer) or (pointer and ts[words[-1] - 1].text == "const")
            kind = "lambda" if is_lambda else "constant" if const else "variable"
            span = (ts[start].start, ts[end - 1].end) if len(parts) == 1 else (ts[words[-1]].start, ts[b - 1].end)
            b = self.add(kind, ts[words[-1]].text, *span, parent)
            scope, k = [], words[-1]
            while k - 2 >= a and ts[k - 1].text == "::" and ts[k - 2].type == "word":
                k -= 2
                scope.insert(0, ts[k].text)
            if scope:
                self.late.append((b, "::".join(scope), ""))


def scan_c(src: str, language: str, macros: bool) -> Document:
    """The language "h" is read as C++ and as C; C is taken only if it has fewer errors."""
    if language != "h":
        return CScanner(src, language, macros).document()
    cpp, c = CScanner(src, "cpp", macros).document(), CScanner(src, "c", macros).document()
    return c if c.errors < cpp.errors else cpp
