import hashlib

import pytest

LONG = " ".join(f"word{k % 7919}" for k in range(30_000))


@pytest.fixture(autouse=True)
def prepared(spark):
    from erisk.llm.common import prepare
    prepare(spark)


@pytest.fixture
def hard_texts():
    """Null, empty, blank, one word, very long, equal and repeated texts."""
    return [None, "", " \n\t ", "word", LONG, "the same text of a few words\nline", "the same text of a few words\nline", "ünïcödé \U0001f600 日本語\n\nx"]


def word(seed: object) -> str:
    """A made-up word, the same for the same seed."""
    h = hashlib.md5(str(seed).encode()).hexdigest()
    return "".join("bcdfghklmnprst"[int(c, 16) % 14] + "aeiou"[int(d, 16) % 5] for c, d in zip(h[:6:2], h[1:6:2], strict=True))


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words in lines, no 5 of which repeat by chance."""
    def make(seed: object, n: int) -> str:
        return "".join(word(f"{seed} {k}") + ("\n" if k % 40 == 39 else " ") for k in range(n)).strip()
    return make


@pytest.fixture
def documents(spark):
    """Documents with columns of clashing names beside the five of the table."""
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, c string, k string, g string, row string, stays boolean"
        return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, "a", "b", "c", "d", False) for r in rows], schema)
    return make
