import zlib

import pytest

from pyspark.sql import functions as F

#: Documents of the odd kinds that every operator takes: nulls, empty and very long texts, repeated rows, null ids.
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "one two three four"), (5, "The same text in two rows."), (6, "The same text in two rows."), (7, "x" * 5000), (8, "many words here " * 4000),
    (9, "<|endoftext|> is a token's string"), (10, "wide space 　 and tabs\t\tand  gaps \n\n end "), (11, "émile Ünder straße 日本語 \U0001f600!!"), (12, "1234 5678 .,;:!?"), (None, "a row without an id"), (13, "it's we'll  's 'll"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns whose names operators might want for themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("score", "predicted", "ids", "digest", "words", "key", "_toxicity", "_lang_pred", "_id", "span", "part", "n_words"):
        df = df.withColumn(name, F.lit("taken"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
