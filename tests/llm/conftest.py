"""Awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing extra columns, no rows."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, row int, score string, rank int, bucket string, size string, copies int"
LONG = " ".join(f"word{k} and more" for k in range(20_000))


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "src0", len(t) if t is not None else None, 7, "x", 1, "y", 2, "b", "s", 3) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def table(spark):
    return lambda texts, ids=None: spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    texts = [None, "", "   \n", "one", "the cat sat on the mat today", "the cat sat on the mat today", LONG, "ß 漢字 😀 " * 30, "?!.", "the cat sat on the mat today"]
    rows = rows_of(texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 5])
    rows += [(None, "a row without id and some words in it", None, None, None, None, None, None, None, None, None, None, None), (11, "no language here", None, None, 16, 7, None, 1, None, 2, None, None, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def folder(tmp_path):
    """Writes named tables as a folder of Parquet, like those that queries read."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write
