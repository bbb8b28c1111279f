import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, h string, pos int, token string, label int, prefix array<int>, words string, position double"


def make(spark, texts, first=0, sources=None):
    """Documents of texts with further columns whose names operators use inside."""
    rows = [(first + i, t, "en", (sources[i] if sources else f"s{i % 3}"), None if t is None else len(t), -i, "x", i, "t", 1, [i], "w", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    same = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the big dark wood today"
    texts = [same, same, None, "", "   \n\t ", "one", "two words", long, long + " more", "é ça b", same + " x", "a\nb\nc\na\nb\nc\nd", same.upper()]
    df = make(spark, texts, sources=[None if i % 4 == 0 else f"s{i % 2}" for i in range(len(texts))])
    nulls = spark.createDataFrame([(None,) * 13], DDL)
    return df.unionByName(df.limit(2)).unionByName(nulls)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
