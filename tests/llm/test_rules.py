import random
import re

import pyarrow as pa
from blockloom.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_lines": len(lines),
    }


TEXTS = [None, "", " ", "a", "a b", "a a a a", "x y z x y z", "l\nl\nl \n\nl", "é é é é", "#$ % |", "\x0bv\x0cf\x1cg h", "A B\tC\r\nA B C"]


def test_measures_against_plain_code():
    r = random.Random(8)
    texts = TEXTS + ["".join(r.choices(["a ", "b ", "c\n", "d# ", "É "], k=r.randint(0, 80))) for _ in range(150)]
    got = rules.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        for k, v in plain(t).items():
            assert got[k][i] == v, (t, k)


def test_many_distinct_words_take_the_other_code():
    words, row = __import__("numpy").array([0, 1, 2, 0, 1, 2, 5]), __import__("numpy").zeros(7, dtype=int)
    assert rules.repeated_words(words, row, 1, 3_000_000).tolist() == rules.repeated_words(words, row, 1, 10).tolist() == [6]


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "few"), (3, "a b c " * 40), (4, "$ " * 30 + good), (5, None), (None, good), (1, good)]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, failures int")
    got = rules.verdicts(docs).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    by = {r.doc_id: r for r in got}
    assert by[2].base_failed and by[3].base_failed and by[5].base_failed and not by[4].base_failed and not by[4].kept
    ledger = rules.ledger(docs)
    table = {r.rule: r for r in rules.ablation(ledger, rules.POLICIES["web-1"]).collect()}
    failed = {n: sum(r.failures >> i & 1 for r in got) for i, n in enumerate(rules.RULES)}
    assert {n: r.failed for n, r in table.items()} == failed
    for i, n in enumerate(rules.RULES):
        assert table[n].kept_without == sum(r.failures & ~(1 << i) == 0 for r in got)
        assert table[n].failed_alone == sum(r.failures == 1 << i for r in got)
    assert rules.verdicts(docs.filter("false")).count() == 0
