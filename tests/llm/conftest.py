import pytest
from pyspark.sql import functions as F


ODD = ("__lang", "__toxic", "__fp", "__id", "__contamination", "row_key", "bits", "bucket", "least", "none", "id", "k", "y", "a b", "dotted.name")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    long = " ".join(words[i * i % 12] for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog for a very long time indeed", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "en"),
        (5, "the cat sat on the mat and looked at the dog for a very long time indeed", "en"), (6, long, "en"), (7, "12345 !!! ???", "de"),
        (7, "12345 !!! ???", "de"), (None, "no id here", "fr"), (8, "a", "fr"), (9, "ÀÉÎ ßü   x\x00y", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("kept") for c in ("score", "fp", "block", "part", "component_id", "contamination", "t", "p", "n", *ODD)}).withColumn(
        "source", F.lit("s")
    )
