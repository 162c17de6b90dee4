import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label string"


@pytest.fixture
def docs(spark):
    """Awkward rows: NULLs, empty and long texts, repeated rows, columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} line{i % 31}" for i in range(20_000))
    rows = [(1, "Alpha beta gamma delta epsilon zeta.\nSecond line here today.", "en", "a", 0, False, "x"),
            (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here today.", "en", "a", 0, False, "x"),
            (2, "", "en", None, 0, None, None), (3, None, None, None, None, None, None), (4, " \t\n ", "fr", "b", 4, True, "y"),
            (None, "No id for this short text at all, none.", "de", "b", 40, True, "z"), (None, None, None, "b", None, None, None),
            (5, long, "en", "a", len(long), True, "w"), (6, "tie tie tie tie tie tie tie tie", "en", "c", 31, True, "w"),
            (7, "ünïcödé ÄÖÜ 日本語 テキスト 😀 \x85 end", "ja", "c", 30, True, "w")]
    return spark.createDataFrame(rows, SCHEMA)
