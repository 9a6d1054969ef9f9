import pytest

TEXTS = [
    None, "", " \n\t", "one", "one two three", "Ünï çödé 漢字 🎉 " * 3, "same text as another row " * 6, "same text as another row " * 6,
    "a line\na line\nanother line\n\n" * 5, "w " * 3000 + "end", "x" * 50_000,
    "mail a@b.co, +49 30 1234567, 10.0.0.1, 4111 1111 1111 1111; token = 'abcdefgh1234'",
    " ".join(f"word{i}" for i in range(300)), " ".join(f"word{i}" for i in range(300)) + " more",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and long texts, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", i, "x", True, 0.5, "k") for i, t in enumerate(TEXTS)]
    rows += [(12, TEXTS[12], "s0", 1, "x", True, 0.5, "k")] * 2 + [(None, "a text without any id at all " * 8, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, digest string, kept boolean, "
                                       "rate double, rep string").repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
