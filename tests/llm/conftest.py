import pytest

ODD = [
    (1, "The quick brown fox. Jumps over the lazy dog's back, it's fine...", "en", 7),
    (2, None, None, None),
    (3, "", "en", 1),
    (4, "  \n\t ", "fr", 1),
    (5, "One", "en", 2),
    (6, "Éé Ünï cöde 你好 x́ ½ a.b,c ... ,,, <|endoftext|>", "fr", 3),
    (7, "same words here now and then " * 40, "en", 4),
    (8, "same words here now and then " * 40, "en", 5),
    (8, "same words here now and then " * 40, "en", 5),
    (9, "long " + "word stream, number 12345. " * 2000, "en", 6),
    (None, "nobody's document with five or more words", "en", 8),
    (None, None, None, None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and a column named like an output."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, length int")
