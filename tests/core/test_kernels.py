import itertools
import random
import sys
import tracemalloc

import pytest
from blockloom.kernels import elements, matching
from blockloom.kernels import spans as kernel_spans
from blockloom.kernels.assignment import best_edges, best_pairs
from blockloom.kernels.blocks import Block
from blockloom.kernels.comments import equal_comments
from blockloom.kernels.distance import osa
from blockloom.kernels.elements import element_text
from blockloom.kernels.lines import ADD, CTX, DEL, align, diff_lines, increasing, word_diff
from blockloom.kernels.spans import smallest_around
from blockloom.kernels.tokens import formatting_only
from blockloom.scan import extract
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_osa(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        cost = a[i - 1] != b[j - 1]
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


#: Empty, equal, swapped, distant and long texts; what is wanted comes from plain_osa.
PAIRS = [("", ""), ("q", "q"), ("", "7"), ("q", "r"), ("mn", "nm"), ("mno", "om"), ("harbour", "arbor"), ("987", "xyz"), ("load_rows", "loadRows"), ("row-list", "RowLists"), ("def total_of(rows)", "class Total extends Sum"), ("ab" * 40, "ba" * 40)]


@pytest.mark.parametrize("a,b", PAIRS)
def test_distance_vectors(a, b):
    want = plain_osa(a, b)
    for cut in (0, 1, 2, 3, 5, 10, None):
        got = osa(a.encode(), b.encode(), cut)
        assert got == (want if cut is None or want <= cut else cut + 1)


def test_distance_of_random_texts():
    r = random.Random(42)
    for _ in range(3000):
        a, b = ("".join(r.choices("abcdefghi", k=r.randint(0, 17))) for _ in range(2))
        assert osa(a.encode(), b.encode()) == plain_osa(a, b)


def test_assignment_is_the_best_of_all():
    r = random.Random(1)
    assert best_pairs([[0.9, 0.6], [0.6, 0.2]], 0.5) == [(0, 1, 0.6), (1, 0, 0.6)]
    assert best_pairs([[0.8, 0.8], [0.8, 0.8]], 0.5) == best_pairs([[0.8, 0.8], [0.8, 0.8]], 0.5)
    for _ in range(150):
        m, n = r.randint(1, 5), r.randint(1, 5)
        table = [[r.choice([-1.0, round(r.random(), 2)]) for _ in range(n)] for _ in range(m)]
        got = best_pairs(table, 0.3)
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got) and all(s >= 0.3 for _, _, s in got)
        ok = lambda i, j: table[i][j] >= 0.3 and table[i][j] != -1
        best = 0.0
        for perm in itertools.permutations([*range(n), *[None] * m], m):
            best = max(best, sum(table[i][j] for i, j in enumerate(perm) if j is not None and ok(i, j)))
        assert sum(s for _, _, s in got) == pytest.approx(best)


def test_assignment_of_many_sparse_pairs():
    """Thousands of rows in one component; among equal pairs the lowest are made."""
    n = 4000
    assert best_edges([(i, j, 0.9 if i == j else 0.6) for i in range(n) for j in (i, i + 1) if j < n]) == [(i, i, 0.9) for i in range(n)]
    assert best_edges([(i, i + 1, 0.8) for i in range(n)] + [(i, i, 0.7) for i in range(n)]) == [(i, i + 1, 0.8) for i in range(n)]
    assert best_pairs([[0.85] * 120 for _ in range(100)], 0.5) == [(i, i, 0.85) for i in range(100)]
    assert best_edges([]) == [] and best_pairs([], 0) == best_pairs([[]], 0) == []


def test_alignment_of_long_lists_in_little_memory():
    r = random.Random(3)
    a = [r.randrange(4000) for _ in range(12_000)]
    b = [v if r.random() < 0.8 else r.randrange(4000) for v in a]
    tracemalloc.start()
    steps = align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a[i] for i, _ in steps if i >= 0] == a and [b[j] for _, j in steps if j >= 0] == b
    assert sum(i >= 0 and j >= 0 for i, j in steps) > 8000 and most < 12_000 * 800  # all rows at once take 18 MB


def test_equal_comments_against_plain_choice():
    r = random.Random(10)
    for _ in range(300):
        old, new = ([(i, r.choice(["a", "b", "", "c"]), r.choice("xy")) for i in sorted(r.sample(range(30), r.randint(0, 14)))] for _ in range(2))
        free, want, done = set(range(len(new))), [], set()
        for inside in (True, False):
            for i, (n, text, where) in enumerate(old):
                near = sorted((abs(n - new[j][0]), new[j][0], j) for j in free if text and new[j][1] == text and (not inside or new[j][2] == where))
                if i not in done and near:
                    want.append((i, near[0][2]))
                    free.discard(near[0][2])
                    done.add(i)
        assert equal_comments(old, new) == want
    many = [(i, "// same", None) for i in range(20_000)]
    assert equal_comments(many, many) == [(i, i) for i in range(20_000)]


def plain_smallest(spans, places, strict):
    out = []
    for start, reach, own in places:
        around = [(e - s, t, i) for i, (s, e, t) in enumerate(spans) if s <= start and e >= reach and s < e and i != own and not (strict and (s, e) == (start, reach))]
        out.append(min(around)[2] if around else None)
    return out


def test_smallest_spans_around():
    r = random.Random(9)
    for case in range(400):
        spans = [(s := r.randint(0, 12), s + r.randint(0, 9), r.randint(0, 2)) for _ in range(r.randint(0, 12))]
        places = [(s := r.randint(0, 14), s + r.randint(0, 6), r.choice([None, r.randrange(12)])) for _ in range(r.randint(0, 8))]
        places += [(s, e, i) for i, (s, e, _) in enumerate(spans)]
        assert smallest_around(spans, places, case % 2 == 0) == plain_smallest(spans, places, case % 2 == 0)


@given(st.lists(st.sampled_from("abc "), max_size=12), st.lists(st.sampled_from("abc "), max_size=12))
@settings(max_examples=200, deadline=None)
def test_alignment_rebuilds_both_and_is_longest(a, b):
    steps = align(a, b)
    assert [a[i] for i, _ in steps if i >= 0] == a and [b[j] for _, j in steps if j >= 0] == b
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    assert sum(i >= 0 and j >= 0 for i, j in steps) == d[-1][-1]


@given(st.text("ab \n", max_size=30), st.text("ab \n", max_size=30), st.booleans(), st.booleans())
@settings(max_examples=300, deadline=None)
def test_diffs_rebuild_both_texts(old, new, space, words):
    lines = diff_lines(old, new, space, words)
    if not lines:
        assert old.rstrip("\n") == new.rstrip("\n") or old.split("\n") == new.split("\n") or old + "\n" == new or new + "\n" == old
        return
    assert "\n".join(x.content for x in lines if x.type != ADD) == (old[:-1] if old.endswith("\n") else old)
    shown = [x.content if x.type == ADD or x.new_content is None else x.new_content for x in lines if x.type != DEL]
    assert "\n".join(shown) == (new[:-1] if new.endswith("\n") else new)


def marked(words):
    return "".join({DEL: f"~{w.text}~", ADD: f"+{w.text}+", CTX: w.text}[w.type] for w in words)


#: Word diffs, ~removed~ and +added+.
WORDS = [
    ("let total = 3;", "let count = 7;", False, 0.4, "let ~total~+count+ = ~3~+7+;"),
    ("resize (Frame &f)", "resize (Frame &f, int width)", True, 0.4, "resize (Frame &f+, int width+)"),
    ("red 10 green 20 blue 30", "RED 10 GREEN 20 BLUE 30", False, 0.4, "~red 10 green 20 blue~+RED 10 GREEN 20 BLUE+ 30"),
    ("red 10 green 20 blue 30", "RED 10 GREEN 20 BLUE 30", False, -1, "~red~+RED+ 10 ~green~+GREEN+ 20 ~blue~+BLUE+ 30"),
    ("we ship nine crates of salt to the old mill", "we ship nine CRATES of salt to the old MILL", False, 0.4, "we ship nine ~crates~+CRATES+ of salt to the old ~mill~+MILL+"),
    ("size(rows)", "size(cols)", False, 0.4, "size(~rows~+cols+)"),
    ("p q", "p  q", True, 0.4, "p  q"),
    ("rate = (sum - 2);", "rate = (sum * 64);", True, 0.4, "rate = (sum ~- 2~+* 64+);"),
]


@pytest.mark.parametrize("old,new,space,threshold,want", WORDS)
def test_word_diffs(old, new, space, threshold, want):
    assert marked(word_diff(old, new, space, threshold)) == want


def test_line_diff_of_a_long_text():
    a = [f"line {i}" for i in range(2100)]
    b = [*a[:1000], "changed", *a[1001:]]
    lines = diff_lines("\n".join(a), "\n".join(b))
    assert [x.type for x in lines].count(DEL) == [x.type for x in lines].count(ADD) == 1
    assert [(x.type, x.content) for x in diff_lines("a\nb\nb\nc", "a\nb\nc\nc")] == [(CTX, "a"), (DEL, "b"), (CTX, "b"), (ADD, "c"), (CTX, "c")]


#: Canonical element texts.
ELEMENTS = [
    ('<span id="top">go</span>', '<span id="top">go>'),
    ("<li>${item}</li>", "<li>{item}>"),
    ("<li .value=${v}>", "<li value={v}>"),
    ("<nav @scroll=${see}>", "<nav scroll={see}>"),
    ("<nav onScroll={see}>", "<nav scroll={see}>"),
    ("<input bool:checked={is_on()}>", "<input checked={is_on()}>"),
    ("<nav @scroll=${{handleEvent: ev => see (ev), once: true }}>", "<nav scroll={ev => see (ev)}>"),
    ('<li @keyup="${Keys.stop}">', "<li keyup={Keys.stop}>"),
    ("<hr/>", "<hr>"),
    ("<em>{m > n}</em>", "<em>{m > n}>"),
]


@pytest.mark.parametrize("source,want", ELEMENTS)
def test_element_texts(source, want):
    assert element_text(source) == want


SAME = [("u * v", "u*v", ""), ("load (k)", "load(k)", ""), ("sum(\nk)", "sum( k)", ""), ("k => m", "k=>m", ""), ("${ key }", "${key}", ""), ("`${k.size}`", "`${k . size}`", ""), ("$((n - m))", "$((n-m))", "bash"), ("r = s / t", "r = s/t", "")]
OTHER = [("throw error", "throwerror", ""), ("k = > m", "k => m", ""), ("m++n", "m + +n", ""), ("'k m'", "'k  m'", ""), ("'k'", '"k"', ""), ("// to do", "// to  do", ""), ("r = /k m/", "r = /k  m/", ""), ("`k m`", "`k  m`", "go"), ("# note", "#  note", "bash"), ('R"(k m)"', 'R"(k  m)"', "cpp"), ("m | | n", "m || n", "")]


@pytest.mark.parametrize("old,new,language,want", [(*x, True) for x in SAME] + [(*x, False) for x in OTHER])
def test_formatting(old, new, language, want):
    assert formatting_only(old.encode(), new.encode(), language, language) is want


@given(st.lists(st.integers(0, 20), max_size=9, unique=True))
def test_increasing_is_longest(values):
    on = increasing(values)
    kept = [v for v, k in zip(values, on) if k]
    assert kept == sorted(kept)
    assert len(kept) == max(len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))


#: Texts that nest n deep, by language.
DEEP = {
    "brackets": ("ts", lambda n: "(" * n + "1" + ")" * n),
    "objects": ("ts", lambda n: "x = " + "{a:" * n + "1" + "}" * n),
    "functions": ("js", lambda n: "function f(){" * n + "}" * n),
    "arrows": ("ts", lambda n: "const g = " + "(x)=>{return " * n + "1" + "}" * n),
    "elements": ("tsx", lambda n: "const x = " + "<a>" * n + "</a>" * n + ";"),
    "templates": ("js", lambda n: "x = " + "`${" * (n // 10) + "1" + "}`" * (n // 10)),
    "unclosed elements": ("tsx", lambda n: "x = " + "<a>" * (n // 10)),
    "unclosed brackets": ("js", lambda n: "{(" * n),
    "namespaces": ("cpp", lambda n: "namespace a{" * (n // 5) + "}" * (n // 5)),
    "classes": ("cpp", lambda n: "struct A{" * (n // 5) + "};" * (n // 5)),
    "blocks of C": ("c", lambda n: "int f(){" + "{" * n + "}" * n + "}"),
    "blocks of Go": ("go", lambda n: "func f(){" + "{" * n + "}" * n + "}"),
    "blocks of Bash": ("bash", lambda n: "f() { " + "{ :; " * n + "}; " * n + "}\n"),
    "substitutions": ("bash", lambda n: "x=" + '"$(echo ' * (n // 10) + ')"' * (n // 10) + "\n"),
}


@pytest.mark.parametrize("name", DEEP)
def test_texts_nest_to_any_depth(name):
    language, text = DEEP[name]
    before = sys.getrecursionlimit()
    shallow, deep = (extract(text(n), language) for n in (20, 10_000))
    assert sys.getrecursionlimit() == before
    assert (shallow.errors > 0) == (deep.errors > 0) and len(deep.blocks) >= len(shallow.blocks)


@pytest.mark.parametrize("strict", [False, True])
def test_few_spans_are_compared_as_many_are_swept(monkeypatch, strict):
    r = random.Random(8)
    for _ in range(300):
        spans = [(s, s + r.randint(0, 9), i // 2) for i, s in enumerate(r.choices(range(12), k=r.randint(0, 7)))]
        places = [(s, s + r.randint(0, 5), r.choice([None, 0, 3])) for s in r.choices(range(14), k=r.randint(0, 8))]
        monkeypatch.setattr(kernel_spans, "FEW", 64)
        few = kernel_spans.smallest_around(spans, places, strict)
        monkeypatch.setattr(kernel_spans, "FEW", -1)
        assert few == kernel_spans.smallest_around(spans, places, strict)


def test_matching_asks_only_what_can_pair(monkeypatch):
    """Comments on one side only need no places, and the path of a parent is made once for all its children."""
    monkeypatch.setattr(matching.Side, "comment_scopes", lambda *_: pytest.fail("no comments to pair"))
    asked = []
    path = matching.Side._path
    monkeypatch.setattr(matching.Side, "_path", lambda self, at: asked.append(at) or path(self, at))
    old = [Block("class", "C", 0, 90, "class C"), *(Block("method", f"m{i}", i, i + 1, f"m{i}", "class:C:0") for i in range(1, 9)), Block("comment", "", 40, 41, "// x")]
    new = [Block("class", "C", 0, 90, "class C"), *(Block("method", f"m{i}", i, i + 1, f"m{i}", "class:C:0") for i in range(1, 9))]
    found = matching.Matcher(old, new).run()
    assert [(p.stage, p.both) for p in found] == [("1", True)] * 9 + [("", False)] and sorted(asked) == ["", "", "class:C:0", "class:C:0"]


def test_plain_sources_are_their_own_element_texts():
    for s in ("", "abc", "a  b", 'x"{y}"', "${z}", "a/>", "tab\tx", " y ?a", "<a onClick=1></a>", "bool:x", "onClick"):
        with_space = elements.element_text(s + " <")
        assert elements.element_text(s) + (" <" if s else "<") == with_space
