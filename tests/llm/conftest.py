import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, digest string, k int, kept string, size int, ids string, base string, host string"
LONG = " ".join(f"wort{i * 7919 % 5003}" for i in range(6000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, a long text, copies, repeated rows, repeated ids, clashing columns."""
    texts = [
        (1, "The same text here, with some words in it."), (2, "The same text here, with some words in it."), (3, None), (4, ""), (5, "   \t\n"), (6, LONG),
        (7, "mail me at jo@ex.example.com or +1 (555) 123-4567"), (8, "12345 !!"), (9, "one two three"), (None, "no id at all"), (None, None), (11, "The same text here, with some words in it."),
        (12, "twice"), (12, "twice"), (13, "id with a text"), (13, "id with another text"), (14, LONG + " tail"), (15, "ÄÖÜ ß 日本語 😀"),
    ]
    rows = [(d, t, None if i % 5 == 0 else "en" if i % 2 else "de", None if i % 7 == 0 else f"s{i % 3}", None, "x", "x", 1, "x", 1, "x", "x", "x") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
