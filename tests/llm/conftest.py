import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, ties, copies, long texts and other columns with clashing names."""
    a = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river bank today " * 3
    rows = [
        (1, None, "en", "s", 0, "x"),
        (2, "", "en", None, 0, "x"),
        (3, a, "en", "s", len(a), "x"),
        (4, a, None, "s", len(a), None),
        (4, a, None, "s", len(a), None),
        (5, a.replace("fox", "cat", 1), "zz", "t", len(a), "x"),
        (None, "short text", "de", "t", 10, "x"),
        (7, "word " * 30000, "en", "s", 150000, "x"),
        (8, "tel +1 (555) 123-4567 mail a.b@c.example.com ip 10.0.0.1 card 4111 1111 1111 1111", "en", "u", 80, "x"),
        (9, "\t \n ", "fr", "u", 4, "x"),
        (10, "é" * 70000, "fr", "u", 70000, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
