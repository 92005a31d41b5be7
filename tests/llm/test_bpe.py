import hashlib
import random

import pytest
from blockloom.llm import bpe
from tokenizers import Tokenizer

ODD = ["", " ", "  a", "a  ", "\n\n\nx", "x\n y", "it's we'll", "é日本", "<|endoftext|>", "a<|endoftext|> b", "a" * 700, "x" * 300 + "y" * 300, " \t\r\n\x0b\x0c", "\0 \0a", "1 22 333", "!?... #a", "　 b", "ſ K"]


@pytest.mark.parametrize("make", [bpe.Codec, bpe.LibraryCodec])
def test_same_ids_as_the_library(tokenizer_path, make):
    c, want = make(tokenizer_path), Tokenizer.from_file(tokenizer_path)
    r = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "é", "日", "!", "1", ",", "<|endoftext|>", "\r\n", "'ll", "\0", "　", "XYZ"]
    texts = ODD + ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)]
    for t in texts:
        ids = want.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids, t
        assert c.decode(ids) == want.decode(ids, skip_special_tokens=False), t


def test_long_words_by_heap_and_scan_agree(tokenizer_path, monkeypatch):
    c, r = bpe.Codec(tokenizer_path), random.Random(5)
    for _ in range(50):
        w = bytes(r.choices(b"abcdet ", k=r.randint(2, 200)))
        short = c.merge(w)
        assert c.merge_long(w) == short


def test_full_memory_changes_nothing(tokenizer_path):
    c = bpe.Codec(tokenizer_path)
    c.keep = 3
    want = bpe.Codec(tokenizer_path)
    for t in ("one two three four five, six. seven", "one, two! three five four nine ten"):
        assert c.encode(t) == want.encode(t)
    assert len(c.words) <= 5


def test_rows(spark, tokenizer_path):
    texts = [*ODD, None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "z", 1), (0, "", 1)], "doc_id long, text string, n_tokens int")
    t = Tokenizer.from_file(tokenizer_path)
    got = bpe.roundtrip(docs, tokenizer_path).collect()
    assert len(got) == len(texts) + 2
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        text = "z" if r.doc_id is None else texts[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    again = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.filter("doc_id > 0"), tokenizer_path), tokenizer_path).collect()}
    assert again == {i: t or "" for i, t in enumerate(texts) if i}
    assert bpe.roundtrip(docs.filter("false"), tokenizer_path).count() == 0
