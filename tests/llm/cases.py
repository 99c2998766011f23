"""Awkward tables shared by the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Besides the columns of ``documents``, names that operators use inside.
DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, size string, taken string, "
    "copies int, keep string, node string, bucket string, tokens string, _row string, key string, parts int, label int"
)
_EXTRA = ("x", "x", "x", 9, "x", "x", "x", "x", "x", "x", 9, 9)


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"{'abcdefgh'[i % 8]}{'lmnopqr'[i % 7]}o{i:x}" for i in range(vocabulary)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n)).replace("\n ", "\n")


def document_rows() -> list[tuple]:
    long_text = prose(40_000, 1)
    near = prose(300, 2)
    texts = [
        (1, ""), (2, None), (None, "seven words that stand without an id"), (3, prose(50, 3)), (3, prose(50, 3)),
        (4, prose(50, 3)), (5, long_text), (6, " \t\n "), (7, "One"), (8, "ONE"), (9, near), (10, near + " and more"),
        (11, "a  b\n\n c d é 字 '́ <|endoftext|> </s> \x1b"), (12, "w" * 70_000), (13, long_text[:-40]),
        (14, None), (15, "tie one two three"), (16, "tie one two three"),
    ]
    langs = ["en", None, "fr"]
    sources = ["b", None, "a", "ü"]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), *_EXTRA) for k, (i, t) in enumerate(texts)]


def documents(spark: SparkSession, parts: int = 3) -> DataFrame:
    return spark.createDataFrame(document_rows(), DOCUMENTS).repartition(parts)


def nothing(df: DataFrame) -> DataFrame:
    return df.filter("1 = 0")
