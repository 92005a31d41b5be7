import random

import public_tokenizers
import pytest

WORDS = {
    "en": "the of and to in is that for with was this from they have been".split(),
    "de": "der die und das ist nicht mit auf für eine wird über schön größe".split(),
}


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


def prose(r, lang="en", n=60):
    made = [r.choice(WORDS[lang]) + r.choice(["", "er", "ing", "lo", "ta"]) for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def labelled(spark):
    """(docs, labels): clean, junk and toxic texts in two languages, with clashing extra columns and odd rows."""
    r = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        lang = "de" if i % 4 == 0 else "en"
        text = prose(r, lang)
        quality, toxic = int(i % 5 != 0), int(i % 6 == 1)
        if not quality:
            text = "\n".join(w.upper() + "!! " + "$$$ " * 3 for w in text.split("\n"))
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grotty", "wretch", "lowbrow", "vermin"]))
            text = " ".join(words)
        docs.append((i, text, lang, "s", i))
        labels.append((i, quality, toxic))
    odd = [(1000, None, None, "s", 1), (1001, "", None, None, None), (1002, " \n\n ", "en", "s", 2), (1003, "a" * 20_000, "en", "s", 3), (None, "the end of it", "en", "s", 4), (1004, "12 34 !!", "en", "s", 5)]
    docs += odd + [docs[7], docs[7]]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long")
    return d.coalesce(2), spark.createDataFrame([*labels, (2000, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
