import pytest

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) pairs."""
    def docs(items, extra=""):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TYPES)
        for name in extra.split():
            out = out.selectExpr("*", f"'x' as {name}")
        return out

    return docs


LONG = "the quick brown fox jumps over the lazy dog again and again until night falls. " * 3000
ODD = [None, "", " \n\t ", "one", "Same text here, twice.\nline two", "Same text here, twice.\nline two", LONG, "ünïcödé — 漢字 😀\x00 end", "a" * 5000]
CLASH = "id key fp g h n c q d rk dk xs x spans rare base score ids word label frauds html url component_id item_id title rows"


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank, equal, very long and odd texts, a null id, a repeated row, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    return make([*rows, (3, "one"), (None, "no id"), (None, None)], CLASH)


@pytest.fixture(scope="session")
def none(make, odd):
    return odd.limit(0)
