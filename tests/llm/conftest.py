import pytest


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) rows, with extra columns that clash."""

    def make(rows, lang="en", source="s0"):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long,"
            " score string, n int, row int, id int, node string, hash string"
        )
        full = []
        for row in rows:
            doc_id, text = row[:2]
            own_lang = row[2] if len(row) > 2 else lang
            own_source = row[3] if len(row) > 3 else source
            size = None if text is None else len(text)
            full.append((doc_id, text, own_lang, own_source, size, "x", 1, 2, 3, "y", "z"))
        return spark.createDataFrame(full, schema)

    return make
