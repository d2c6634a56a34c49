import pytest

SF = "/root/testdata/sf0.001"

#: Texts that operators meet at their edges: null, empty, blank, ties, repeats, long, odd characters.
EDGE_TEXTS = [
    None, "", " \t\n", "one", "one", "Ünï cödé ﬀ 日本語 \U0001f600 text\x0bwith\x1codd     space",
    "a b c d e f " * 3000, "x" * 70000, "<|endoftext|> the <|startoftext|> end", "tab\tand\r\nnew  lines\n\n\nhere ",
    "Licensed under the GNU  General Public\nLicense, CC-BY and the MIT license.", "#$% | <> && **",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every edge text, a null id, repeated rows and columns whose names clash with results'."""
    rows = [(i if i != 3 else None, text, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, -i, i, "clash") for i, text in enumerate(EDGE_TEXTS)]
    rows += [rows[6], rows[6], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, size long, sequence_id string")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
