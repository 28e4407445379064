"""Small tables with the awkward rows every operator must stand."""

import os
import tempfile

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000


def awkward(spark, extra: bool = True):
    """Null text, null id, empty and white-space texts, a very long text, repeated rows,
    copies, and extra columns whose names clash with outputs."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"),
        (6, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, None), (7, "Ünïcödé 🙂 漢字 ½ x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("score", "n_words", "ids", "fingerprint", "spans", "items", "shard", "licenses", "sentences", "predicted", "source", "lang"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def written(df, name: str) -> str:
    """A data folder that holds just this table."""
    folder = tempfile.mkdtemp(prefix="probanda-test-")
    df.write.parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
