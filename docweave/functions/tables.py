"""Table functions for SQL: ``SELECT ... FROM t, LATERAL split_assertions(t.text)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docweave.functions.markdown import sentences_of
from docweave.operators.chunking import MAX_CHARS, OVERLAP_CHARS, cut_points


class _Assertions:
    def eval(self, text: str):
        for position, sentence in enumerate(sentences_of(text or "")):
            yield position, sentence


class _Oversized:
    def eval(self, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS):
        for begin, finish in cut_points(text, max_chars, overlap) if text else ():
            yield begin, finish, text[begin:finish]


def register_table_functions(spark: SparkSession) -> None:
    """Make both functions callable from SQL in this session."""
    spark.udtf.register("split_assertions", udtf(_Assertions, returnType="pos int, sentence string"))
    spark.udtf.register(
        "split_oversized", udtf(_Oversized, returnType="char_start int, char_end int, text string")
    )
