import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, shard int, Slot long, fingerprint string, component_id long, held_out boolean, labels string, word string, bucket int, kept boolean"
PROSE = "The quick brown fox jumps over the lazy dog and then it rests by the river for a while, as all foxes do. "


def edge_rows():
    long = PROSE * 1500 + "x" * 5000 + " end."
    texts = [
        (1, PROSE * 3),
        (2, None),
        (3, ""),
        (4, long),
        (5, PROSE * 3),
        (5, PROSE * 3),
        (6, " \n\t \x0b "),
        (7, "Ñandú über straße 日本語テキスト 😀 İstanbul ΣΑΣ é <|endoftext|> \x00 \x1c ▁ <s>\r\nthe the"),
        (8, "one two"),
        (9, "Released under the MIT License."),
        (None, "A document without an id, " + PROSE),
        (9_007_199_254_740_993, PROSE * 2 + "Large ids stay exact."),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 2 else "src0", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS)
    for part in CLASHING.split(", "):
        name, kind = part.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(small):
    import pyarrow.parquet as pq

    return pq.read_table(f"{small}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)
