import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents and rows that are hard on every operator."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = [
        (9001, None, "en", None, 0),
        (9002, "", None, "src0", 0),
        (9003, " \n\t ", "fr", "src0", 4),
        (9004, "1234 !!! 5678", "de", "src1", 13),
        (9005, "café \U0001f600 Ünḯ <|endoftext|> 'LL ｆｕｌｌ 漢字 " * 3, "en", "src1", 100),
        (9006, "word " * 30_000, "en", "src0", 150_000),
        (9007, "x" * 20_000, "en", "src0", 20_000),
        (9008, "one two three", "en", "src0", 13),
        (9008, "one two three", "en", "src0", 13),
        (9009, "one two three", "en", "src0", 13),
    ]
    extra = spark.createDataFrame(odd, base.schema)
    return base.unionByName(extra)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
