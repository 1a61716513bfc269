import pytest

WORDS = "the cat sat on a mat while rain fell over hills and rivers ran past old stone mills toward grey seas".split()


def sentence(seed: int, n: int) -> str:
    """A reproducible text of n words."""
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state // 65536 % len(WORDS)] + ("s" if state % 5 == 0 else ""))
    return " ".join(out)


AWKWARD = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "a"), (5, "a"), (5, "a"), (6, "A"), (7, "12345 !!"), (None, "lost row"), (None, None),
    (8, "é" * 50), (9, "日本 語 text"), (10, sentence(1, 40_000)), (11, "<|endoftext|> x"), (12, "\x1c odd \x85 \xa0 space"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty, repeated, tied and very long texts, and columns with clashing names."""
    rows = [(i, t, "en", "s", 0, "x", 1.0, 7) for i, t in AWKWARD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, n int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
