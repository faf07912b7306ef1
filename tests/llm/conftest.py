import pytest
from invented import sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, key string, score double, class_id long, ids string, _rid int, _th int, _pseudonymised int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names operators use."""
    long = " ".join(sentence(k, 60) for k in range(900))
    texts = [
        (1, sentence(1), "en"), (2, sentence(2), "fr"), (3, None, "en"), (4, "", None), (5, "!!! ... \n", "de"), (6, "one", "en"), (7, "one", "en"),
        (8, long, "en"), (9, "x" * 300_000, "en"), (10, sentence(1), None), (10, sentence(1), None), (None, sentence(3), "en"), (None, None, None), (None, sentence(1), "en"),
        (11, "Straße ÉTÉ naïve ½ 中文字 😀 café " + sentence(4), "de"), (12, long + " tail", "en"), (13, "<|endoftext|> a<|startoftext|>b", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "s", None, "r", "k", 1.0, 5, "i", 1, 2, 3) for i, t, g in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
