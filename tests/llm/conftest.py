import pytest
from pyspark.sql import Row, types as T

from voltlattice.llm.common import prepare

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators might use for themselves.
    *(T.StructField(n, T.StringType()) for n in ("id", "doc", "n", "key", "score", "places", "_document", "_places", "_gone", "block", "label", "p", "_language")),
])
PASSAGE = " ".join(f"word{k}" for k in range(60))
LONG = "\n".join(" ".join(f"w{(k * j) % 977}" for k in range(40)) for j in range(400))

TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "One  two\nthree"), (6, "one two three"),
    (7, PASSAGE), (8, "A head.\n" + PASSAGE + "\nA tail."), (9, PASSAGE + "\nA tail."), (10, PASSAGE), (11, PASSAGE),
    (12, LONG), (13, LONG + " more"), (14, "short line\nshort line\nshort line"), (15, "?!? 123 ..."),
    (16, "Übung macht den Meister, ß und é. \U0001f389▁ x"), (17, "a  b   c \n d"), (18, "<|endoftext|> and\r\nmore"),
    (None, "no id"), (None, PASSAGE), (12, LONG), (20, "one id"), (20, "two texts"), (21, "x" * 5000), (22, None),
]


def odd_rows():
    langs = ["en", "de", None]
    return [Row(doc_id=i, text=t, lang=langs[k % 3], source=None if k % 4 == 0 else "s", n_chars=None if k % 5 == 0 else len(t or ""),
                **{f.name: "clash" for f in SCHEMA.fields[5:]}) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="session")
def llm_spark(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(llm_spark):
    return llm_spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)
