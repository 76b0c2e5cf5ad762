import pytest


@pytest.fixture(scope="session")
def shape():
    """Rows of a frame as sorted tuples of text, for comparing."""

    def rows(df, *columns):
        return sorted(tuple(map(repr, r)) for r in df.select(*(columns or df.columns)).collect())

    return rows
