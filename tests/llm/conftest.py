"""Small documents with every awkward case: nulls, empty and long texts, repeats, ties, and columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def sample_texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(3, 90)) + "." for _ in range(14)]
    near = base[3].split()
    near[5 % len(near)] = "changed"
    return [
        None, "", " \t\n", *base, base[3], base[3], " ".join(near), base[0].upper(), "In " * 60, "a  b   c ", " lead and trail ", "é ü ß x   y ▁z 😀\x00q", "x" * 9000,
        words(rng, 4000), "line one is here.\nline one is here.\n\nline two, too.\n", "\n".join([base[1]] * 3),
    ]


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """The documents' columns beside others whose names operators use themselves; ids null and repeated."""
    extra = "_t string, t string, w string, rid long, held int, fp long, score double, lang_pred string, ids int, m string, rejected int, key int"
    rows = [(1, "some words here. and more words there.", "en", "s", 38, *[None] * 12), (1, "some words here. and more words there.", "en", "s", 38, *[None] * 12), (None, "other text", "fr", "s", 10, *[None] * 12)]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def vocabulary_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
