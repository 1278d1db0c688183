"""Fixtures shared by the tests of the corpus operators."""

import duckdb

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [  # id, text: nulls, empties, repeated rows, equal ids, a very long text, odd characters
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " \n\t "), (None, "No id at all."), (5, LONG), (6, "a"),
    (1, "The quick brown fox jumps over the lazy dog."), (1, "Another text of the same id."), (7, "漢字 é́ 　 <|endoftext|> x<s>▁y  z"), (8, "!!! 123"), (9, "x" * 70_000)]


def docs(spark, rows=ROWS):
    """Documents with further columns whose names operators use themselves."""
    full = [(i, t, "en", "src0", 0 if t is None else len(t), 1, "k", 0.5, -1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, block int, word string, score double, node long")


def fixture(table):
    return duckdb.connect().sql(f"select * from '{SF}/{table}.parquet'").fetchall()


def texts():
    return duckdb.connect().sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
