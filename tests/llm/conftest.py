import pytest

SHAPE = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "row string, digest string, size string, tokens string, window string, n_lines string, id string"
)
PROSE = "the quick brown fox jumps over the lazy dog while seven bright stars shine above a quiet harbour town. "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    words = " ".join(f"w{i * 7919 % 100003}" for i in range(20_000))
    texts = [
        (1, "one two three four five six seven", "en"),
        (1, "one two three four five six seven", "en"),  # a repeated row
        (2, "One two three four FIVE six seven", "en"),
        (3, None, "en"),
        (4, "", "de"),
        (5, " \n\t ", None),
        (None, "one two three four five six seven", "en"),
        (None, None, None),
        (6, "12 34 --- !!", "fr"),
        (7, words, "en"),
        (8, words + " and one more", "en"),
        (9, PROSE * 3, "en"),
        (10, "eine kleine zeile\n" + "eine kleine zeile\nund noch eine ganz andere zeile die bleibt", "de"),
        (10, "another text of the same id", "en"),
        (11, "x" * 50_000, "de"),
    ]
    rows = [(i, t, lang, None if n % 4 == 3 else f"src{n % 3}", None, "a", "b", "c", "d", "e", "f", "g") for n, (i, t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
