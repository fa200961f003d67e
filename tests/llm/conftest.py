"""Small tables with awkward rows, shared by the corpus tests."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, long_text), (7, long_text + " tail"),
        (8, "Alpha beta gamma delta epsilon zeta eta theta.\n\nIota kappa."), (8, "Alpha beta gamma delta epsilon zeta eta theta.\n\nIota kappa."),
        (9, "naïve ﬁ   中文 \U0001f600 text. Next, phrase\nline"), (None, "no id here at all, none"), (None, None),
    ]
    extra = [(i, t, None, "src", 5, "n", "b", "g", 7) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket string, gram string, length long"
    return spark.createDataFrame(extra, names)
