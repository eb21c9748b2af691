import pytest

# Rows that every operator must get along with: nulls, blanks, repeated rows, a long text.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, _host string, fp long"


def odd_rows():
    long = " ".join(f"word{i % 700} and line" for i in range(20_000))
    rows = [
        (1, "A first text of some words that stand here", "en", "a"),
        (1, "A first text of some words that stand here", "en", "a"),
        (2, None, None, None),
        (3, "", "en", None),
        (4, " \n\t ", "de", "b"),
        (5, long, "en", "b"),
        (None, "A text without a key", None, "b"),
        (None, None, None, None),
        (-7, "Ünïcode ß \x00 \U0001f600 text\nwith lines\n\nand blanks", "fr", ""),
    ]
    return [(*r, 0, 1, 2, "h", 3) for r in rows]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture()
def none(odd):
    return odd.limit(0)
