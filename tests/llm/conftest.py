import pytest

from palisade import ship

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 5, "x", "p"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "b", None, None, None),
    (3, None, "a", 1, "y", "p"),
    (4, "", None, 1, "y", "p"),
    (5, "   \n\t ", "b", 1, "y", "p"),
    (6, "one two", "b", 1, "y", "p"),
    (7, LONG, "c", 1, "y", "p"),
    (8, LONG + " tail", "c", 1, "y", "p"),
    (9, "é\u00a0ü ſecret \u2028 token=abc 中文 <|endoftext|> 😀", "c", 1, "y", "p"),
    (9, "é\u00a0ü ſecret \u2028 token=abc 中文 <|endoftext|> 😀", "c", 1, "y", "p"),
    (10, "one two", "c", 1, "y", "p"),
    (None, "one two", None, 1, "y", "p"),
    (11, "no id twin", "c", 1, "y", "p"),
    (None, "lonely words here", "c", 1, "y", "p"),
]
#: Columns beside doc_id, text and source have names that the operators use inside.
SCHEMA = "doc_id long, text string, source string, size long, cls string, block string"


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    return llm.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], SCHEMA)
