import pytest

SF = "/root/testdata/sf0.001"
#: Null, empty and odd texts; a repeated row; columns named like results.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "the quick brown fox jumps over the lazy dog again and again and again"),
    (7, "the quick brown fox jumps over the lazy dog again and again and again"), (7, "the quick brown fox jumps over the lazy dog again and again and again"),
    (None, "text without an id"), (8, "x" * 5000), (9, "w " * 3000), (10, "line\nline\n\nline ### $$ |"), (11, "<|endoftext|> É中文 \U0001F600 's ’s\x1c\x85 end"),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    names = "n bigint, score double, kept boolean, host string, TEXT_CRC32 bigint, n_words string, rule string, license string, n_tokens string, size string, shard int"
    rows = [(i, t, None, None, None, "h", 1, "w", "r", None, "t", "s", 9) for i, t in EDGE]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
