import pytest

from tandem.llm.common import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Invented documents, whole."""
    return prepare(spark).read.parquet(f"{SF}/documents.parquet")


#: Nulls, empty and odd texts, ties, repeated rows; long enough to be cut into pieces where pieces exist.
ODD = [
    (None, None, None), (None, "no id", "en"), (1, None, "en"), (2, "", None), (3, "Same text here", "en"), (3, "Same text here", "en"), (4, "same TEXT here", "en"), (5, "same text here ", "en"),
    (6, " \t\n ", "en"), (7, "12345 !!! ...", "en"), (8, "ÄÖÜ straße 日本語　テキスト \U0001f600", "de"), (9, "a  b\n c   d \x1c e\x85 f", "en"), (10, "x\0y", "en"), (11, "word " * 70_000, "en"),
    (12, "don't stop; it's 3.14, 1,000!", "en"), (13, "<|endoftext|> \x01 x\x01", "en"), (3, "another text for the same id", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names the operators use for themselves."""
    rows = [(d, t, lang, "s", "k0", "size", 7) for d, t, lang in ODD]
    return prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, k0 string, size string, fp int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
