import itertools
import time
from collections import Counter

import pytest
from blockloom.kernels.blocks import Block, raw
from blockloom.kernels.matching import Matcher
from blockloom.kernels.review import review
from blockloom.options import Options
from blockloom.plans.fixtures import SOURCES
from blockloom.scan import detect, extract
from blockloom.scan.markup import elements

#: Two versions of a small program: a constant, a string, a body and a method's name differ.
OLD = """// Tide tables for small harbours.
export const STEP_MINUTES = 15;

export class TideTable {
  constructor(readings) {
    this.readings = readings;
  }

  highest() {
    let best = this.readings[0];
    for (const r of this.readings) {
      if (r.level > best.level) best = r;
    }
    return best;
  }

  between(from, until) {
    return this.readings.filter((r) => r.at >= from && r.at < until);
  }
}

export function describe(reading) {
  return reading.at + " " + reading.level + " m";
}
"""
NEW = OLD.replace("STEP_MINUTES = 15", "STEP_MINUTES = 30").replace("between(from", "within(from").replace(' m";', ' metres";').replace("    return best;\n", "    this.last = best;\n    return best;\n")


def names(src, file):
    return [(b.kind, b.name) for b in extract(raw(src), detect(file), True).blocks]


def test_report_of_a_program():
    r = review(OLD, NEW, "a/tides.js", "b/tides.js", Options(skip_unchanged=True))
    text = r.text()
    comment_above = "Constants\n@@ -1,2 +1,2 @@  STEP_MINUTES  98% similarity  [changed]\n // Tide tables for small harbours.\n"
    assert comment_above + "-export const STEP_MINUTES = 15;\n+export const STEP_MINUTES = 30;\n" in text
    assert "@@ -9,7 +9,8 @@  highest  93% similarity  [changed]\n" in text and "+    this.last = best;\n" in text
    assert "  between → within  72% similarity  [changed]\n-between(from, until) {\n+within(from, until) {\n" in text
    assert text.endswith("Summary\n  Renamed:   1\n  Changed:   4\n  Matched:   6\n  Unchanged: 2\n\n")
    assert r.report.summary() == dict(added=0, removed=0, renamed=1, moved=0, changed=4, matched=6, unchanged=2, whitespace=0)


EXTRACTED = [
    ("m.mjs", "import 'polyfill';\nimport fs from 'node:fs';\nimport * as path from 'node:path';\nexport * from './shapes';\nexport { area, round as near };\n", [("import", "polyfill"), ("import", "fs"), ("import", "path"), ("export", "./shapes"), ("export", "area, round")]),
    ("m.ts", "let retries = 3, pause = (ms) => wait(ms);\nconst greet = function () {};\nvar later;\n", [("variable", "retries"), ("arrow_function", "pause"), ("function", "greet"), ("variable", "later")]),
    ("m.ts", "function season(month) {\n  const warm = month > 4;\n  function half() { return warm; }\n  return half;\n}\n", [("function", "season"), ("function", "half")]),
    ("m.ts", "interface Berth { depth: number }\ntype Mooring = Berth | Buoy;\nenum Wind { Calm, Gale }\n", [("interface", "Berth"), ("type_alias", "Mooring"), ("enum", "Wind")]),
    ("m.js", "const ferry = {\n  depart() { return 'now'; },\n  connectedCallback() {},\n  seats: 40,\n};\n", [("constant", "ferry"), ("object_method", "depart"), ("lifecycle", "connectedCallback")]),
    ("m.jsx", "const Card = () => (\n  <article>\n    <h2>{title}</h2>\n    <img src={photo}/>\n  </article>\n);\n", [("arrow_function", "Card"), ("jsx", "article"), ("jsx", "h2"), ("jsx", "img")]),
    ("m.ts", "const list = html`<ol><li>one</li></ol><hr/><footer>end</footer>`;\nconst look = css`<ol></ol>`;\n", [("constant", "list"), ("template", "ol"), ("template", "hr"), ("template", "footer"), ("constant", "look")]),
    (
        "m.go",
        'package harbour\nimport "strings"\ntype Ship struct{ name string }\ntype Crane interface{ Lift() }\ntype Tons = float64\nfunc (s Ship) Hail() string { return s.name }\nfunc Load() { kilos := 2 }\nvar berths = 9\nconst (\n\tnorth = iota\n\tsouth\n)\n',
        [("import", '"strings"'), ("class", "Ship"), ("interface", "Crane"), ("type_alias", "Tons"), ("method", "Hail"), ("function", "Load"), ("variable", "berths"), ("constant", "north"), ("constant", "south")],
    ),
    ("m.sh", '#!/bin/sh\nPORT=8080\nfunction serve {\n  LOCAL=1\n}\nstop() { kill "$PID"; }\n', [("comment", ""), ("variable", "PORT"), ("function", "serve"), ("function", "stop")]),
    (
        "m.c",
        '#include "tide.h"\n#define DEPTH 12\n#define HALF(n) ((n) / 2)\ntypedef struct Buoy { int id; } Buoy;\nenum Flag { RED };\nstatic const double draft = 2.5;\nlong hours, minutes = 5;\nint sound(int fathoms) { int left; return fathoms; }\n',
        [("import", '"tide.h"'), ("constant", "DEPTH"), ("macro_function", "HALF"), ("type_alias", "Buoy"), ("enum", "Flag"), ("constant", "draft"), ("variable", "hours"), ("variable", "minutes"), ("function", "sound")],
    ),
    (
        "m.cpp",
        "namespace dock {\nclass Winch {\n public:\n  explicit Winch(int teeth) : teeth_(teeth) {}\n  ~Winch();\n  int turns() const;\n private:\n  int teeth_;\n};\nint Winch::turns() const { return teeth_ * 2; }\ntemplate <class N>\nN clampTo(N low, N v) { return v < low ? low : v; }\nusing Ropes = std::map<int, Winch>;\nauto twice = [](int k) { return 2 * k; };\n}\n",
        [("namespace", "dock"), ("class", "Winch"), ("method", "Winch"), ("method", "~Winch"), ("method", "turns"), ("method", "turns"), ("function", "clampTo"), ("type_alias", "Ropes"), ("lambda", "twice")],
    ),
]


@pytest.mark.parametrize("file,src,want", EXTRACTED)
def test_blocks_of_each_language(file, src, want):
    assert names(src, file) == want


def test_spans_cover_whole_statements():
    b = extract(raw("export const größe = 40;\nlet low = 2, high = 9;\n"), "ts").blocks
    assert [x.source for x in b] == [raw("export const größe = 40;"), "low = 2", "high = 9"] and b[0].end == 26


def test_comment_runs():
    count = lambda s: [(b.start_line, b.end_line) for b in extract(s, "js").blocks if b.kind == "comment"]
    assert count("// tide\n// moon\n// wind\n// rain\n") == [(0, 3)]
    assert count("/* first\n   second */\n// third\n") == [(0, 1), (2, 2)]
    assert count("// above\n\n\n// below\n") == [(0, 0), (3, 3)]
    assert len(count("let level = 4; // metres\n// more\n")) == 2


MARKUP = [("<ul><li>a</li></ul><hr><table></table>", ["ul", "hr", "table"]), ("<input><wbr>", ["input", "wbr"]), ('<p class="y"', []), ("<ol><li>open", []), ("<main><LINK><b>t</b></main>", ["main"]), ("<em title='${pick('>')}'>w</em>", ["em"])]


@pytest.mark.parametrize("source,want", MARKUP)
def test_markup(source, want):
    assert [n for _, _, n in elements(source)] == want


@pytest.mark.parametrize("lang,src", [("ts", "let y = ] {"), ("js", "call(1, [2)"), ("go", "func load() { ?? }"), ("bash", "while do done ]] }"), ("c", "`"), ("c", "long n = 4"), ("cpp", "$ @")])
def test_broken_sources_count_errors(lang, src):
    assert extract(src, lang).errors >= 1


@pytest.mark.parametrize("key", [k for k in SOURCES if k != "quux"])
def test_clean_sources_have_no_errors(key):
    name, old, new = SOURCES[key]
    assert extract(raw(old), detect(name)).errors == extract(raw(new), detect(name)).errors == 0


COMBINATIONS = [(SOURCES[a][0], SOURCES[a][1], SOURCES[b][0], SOURCES[b][2]) for a, b in itertools.product(SOURCES, SOURCES)]
COMBINATIONS += [("a.ts", "", "a.ts", SOURCES["ts"][1]), ("a.ts", SOURCES["ts"][1], "a.ts", ""), ("a.ts", " \n\n", "a.ts", "\n"), ("x", "a\nb", "y.go", "c"), ("a.ts", "const x = ) (\n", "a.ts", "function (\n")]


@pytest.mark.parametrize("case", COMBINATIONS)
@pytest.mark.parametrize("options", [Options(), Options(ignore_space=True), Options(simple_diff=True)])
def test_every_line_is_shown_as_often_as_it_occurs(case, options):
    old_name, old, new_name, new = case
    r = review(old, new, old_name, new_name, options)
    body = r.text().split("\n")[1:]
    shown = Counter(line[1:].strip() for line in body if line[:1] in "+- ")
    folded = sum("// [matched: " in line for line in body)
    for side in (old, new):
        for line, n in Counter(x.strip() for x in side.split("\n") if x.strip()).items():
            assert shown[line] >= 1 or folded, line
    assert len(body) <= 4 * (old.count("\n") + new.count("\n") + 2) + 40
    assert r.text() == review(old, new, old_name, new_name, options).text()
    for p in r.pairs:
        if p.both and p.diff is not None and r.report.similarity(p) == 100 and "whitespace" not in r.report.tags(p):
            assert not p.has_changes()


def test_identical_sources_are_unchanged():
    for name, src, _ in SOURCES.values():
        s = review(src, src, name, name).report.summary()
        assert s["unchanged"] == s["matched"] > 0 and s["changed"] == s["added"] == s["removed"] == 0


def block(kind, name, start, source, parent="", size=10):
    return Block(kind, name, start, start + size, source, parent)


def stages(old, new, threshold=0.5):
    return [(p.old and p.old.name, p.new and p.new.name, p.stage) for p in Matcher(old, new, threshold).run()]


def test_matching_stages():
    body = "return a + b + c + d;"
    assert stages([block("function", "f", 0, body)], [block("function", "f", 50, "x")]) == [("f", "f", "1")]
    assert stages([block("function", "load", 0, body)], [block("function", "loadAll", 0, body)]) == [("load", "loadAll", "3a")]
    assert stages([block("function", "a", 0, "xxxxxxxx")], [block("class", "b", 0, "yyyyyyyy")]) == [(None, "b", ""), ("a", None, "")]
    assert stages([block("comment", "", 0, "// a")], [block("comment", "", 9, "// a")]) == [("", "", "2")]
    assert stages([block("comment", "", 0, body)], [block("function", "", 0, body)]) == [(None, "", ""), ("", None, "")]
    old, new = block("class", "K", 0, "k"), block("class", "K", 0, "k")
    pairs = stages([old, block("method", "m", 1, body, old.id)], [new, block("method", "n", 1, body, new.id)])
    assert pairs == [("K", "K", "1"), ("m", "n", "3b")]
    old, new = block("class", "Aaaa", 0, "pppppppp"), block("function", "zzz", 0, "qqqqqqqqqq")
    pairs = stages([old, block("method", "keep", 1, body, old.id)], [new, block("function", "keep", 1, body, new.id)])
    assert ("keep", "keep", "3d") in pairs


def test_namespace_is_transparent_and_isolated():
    ns = block("namespace", "n", 0, "x" * 30, size=90)
    assert stages([ns, block("function", "f", 5, "b", ns.id)], [block("function", "f", 0, "b")]) == [("f", "f", "1"), ("n", None, "")]


def test_moved_and_whitespace():
    a, b, c = "function a() { return 1; }\n", "function b() { return 22; }\n", "function c() { return 333; }\n"
    r = review(a + b + c, c + a + b, "x.ts", "x.ts")
    assert r.report.summary()["moved"] == 1 and "[moved]" in r.text()
    r = review("int f() {\n  return 1;\n}\n", "int f() {\n    return 1;\n}\n", "x.c", "x.c")
    assert r.report.summary()["whitespace"] == 1 and "[whitespace]" in r.text()


def test_long_lines_and_odd_bytes():
    long = "x" * 300_000
    assert review(long, long + "y", "a.txt", "b.txt").report.summary()["changed"] == 1
    bad = b"const a = '\xff\xfe';\n".decode("utf-8", "surrogateescape")
    assert review(bad, bad, "a.ts", "a.ts").report.summary()["unchanged"] == 1


CPP = [
    ("struct Money {\n  Money& operator+=(const Money&);\n  operator long() const;\n  int operator[](int);\n};\n", ["Money", "operator+=", "operator long", "operator[]"]),
    ("struct Later;\nclass Soon;\nstruct Now {\n  char c;\n};\n", ["Now"]),
    ("typedef long Cents, Euros;\ntypedef void (*Done)(long), (*Failed)(char);\n", ["Cents", "Euros", "Done", "Failed"]),
    ("char flag;\nlong low, high;\nint (*compare)(const void *);\nlong tell(char);\n", ["flag", "low", "high", "compare", "tell"]),
    ("int run() {\n  struct Inner { int go() { return 1; } };\n  return 0;\n}\n", ["run"]),
    ("class Bell {\n  auto ring = [](int n) { return n; };\n  int rung = 0;\n};\n", ["Bell", "ring"]),
]


@pytest.mark.parametrize("src,want", CPP)
def test_more_of_cpp(src, want):
    assert [b.name for b in extract(src, "cpp").blocks] == want


def test_members_outside_their_class():
    src = "namespace east { struct Pier { int length(); static long built; }; }\nnamespace west { struct Pier { int length(); }; }\nnamespace east { int Pier::length() { return 3; } }\nint west::Pier::length() { return 4; }\nlong east::Pier::built = 1900;\n"
    found = [(b.kind, b.name, b.scope) for b in extract(src, "cpp").blocks if b.kind in ("method", "variable")]
    assert found == [("method", "length", "east::Pier"), ("method", "length", "west::Pier"), ("method", "length", "east::Pier"), ("method", "length", "west::Pier"), ("variable", "built", "east::Pier")]


def test_constness_follows_the_declarator():
    src = "const char *label = 0;\nchar * const seal = 0;\nconst long (*table)(int) = 0;\nconstexpr double RATIO = 3.1;\n"
    assert [(b.kind, b.name) for b in extract(src, "cpp").blocks] == [("variable", "label"), ("constant", "seal"), ("variable", "table"), ("constant", "RATIO")]


def test_inline_types_and_objects_do_not_overlap():
    b = extract("union Word { long l; char c; } word = {7};\nenum Tide { EBB, FLOW } tide = EBB;\n", "c").blocks
    assert [(x.name, x.source) for x in b] == [("Word", "union Word { long l; char c; }"), ("word", "word = {7};"), ("Tide", "enum Tide { EBB, FLOW }"), ("tide", "tide = EBB;")]


def test_script_expressions():
    src = "watch(function () { tick(); });\nexport default (n) => n + 1;\nconst same = <K,>(k: K): K => k;\nconst last = 2\n;\n"
    assert [(b.kind, b.name) for b in extract(src, "tsx").blocks] == [("function", "<anonymous>"), ("arrow_function", ""), ("arrow_function", "same"), ("constant", "last")]


def test_deeply_nested_equal_tags_in_usable_time():
    """Three hundred nested elements of one name: every pair of them is compared, and the assignment has one component."""
    nested = lambda n, leaf: "const page = " + "<div>" * n + leaf + "</div>" * n + ";\n"
    start = time.perf_counter()
    pairs = Matcher(*(extract(nested(300, leaf), "tsx").blocks for leaf in ("old", "new"))).run()
    assert sum(p.both for p in pairs) == 301 and time.perf_counter() - start < 15
