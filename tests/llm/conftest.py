import pytest

#: Texts that every operator must stand: null, empty, white space, one word, no letters, control strings, other scripts, long.
HARD = [None, "", " \n\t ", "word", "12 34 ## $$", "<|im_end|><|endoftext|> a\\b", "日本語 のテキスト ѐ é\u0085​ x", "a" * 5000, " ".join(f"w{i % 700}" for i in range(30_000))]


@pytest.fixture(scope="session")
def hard(spark):
    """Hard documents with a repeated row, a null id and extra columns with clashing names."""
    rows = [(i, t, "en", "s", None, "x", 1, "y") for i, t in enumerate(HARD)]
    rows += [rows[3], (None, "no id here at all but a text of some ten words or so", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, keys int, comp string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
