import pytest

from clickloom.llm.common import Scratch

#: NULL ids and texts, empty and white texts, ties, repeated rows, one long text, odd characters.
LONG = "the long line of words that goes on and on and on again\n" * 4000
SHARED = "this very line is found in many of the documents here"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None), (6, LONG),
    (7, "Ünïcode ﬀ 日本語 текст 🙂🙂 <|endoftext|> \x00 end"), (8, "a  b\r\n c\x0b\x1fd"),
    *[(100 + i, f"{SHARED}\nown text number {i} with some more words to tell it apart {i * 7} {i * 13}") for i in range(12)],
    (200, f"  {SHARED.upper()}\t\nend"), (201, SHARED), (202, SHARED),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with extra columns whose names clash with those that operators use."""
    rows = [(i, t, "en", "src0", None, 1, 2, "x", [1], "y") for i, t in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long, fp int, size int, line string, k1 array<int>, block string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables to a folder and gives its path."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
