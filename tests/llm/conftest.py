import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, key string, _id bigint, start_char bigint, values array<int>"


def rows_of(pairs):
    """Documents with columns whose names the operators use themselves."""
    return [(i, t, "en", "s", None if t is None else len(t), 0.5, 9, "k", 7, 1, [1]) for i, t in pairs]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda pairs: spark.createDataFrame(rows_of(pairs), DOCS)


LONG = " ".join(f"w{i % 977} x{i}" for i in range(12_000))


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "ONE two"), (6, LONG), (7, LONG), (None, "a null id with more than five words"), (8, "é ß 日本 \U0001f600 <|endoftext|> [INST]"), (9, "the same line\nthe same line\nthe same line")])


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
