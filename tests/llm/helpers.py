"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts, ids=None, extra: bool = False) -> DataFrame:
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:                          # names that the operators use for their own columns
        for c in ("score", "predicted", "fp", "u", "v", "root", "key", "label", "y", "spans", "base", "item_id", "sequence_id", "offset",
                  "length", "_rank", "_bin", "_first", "component_id", "held_out", "rank", "part", "block", "count", "n", "x"):
            df = df.selectExpr("*", f"'extra' as `{c}`")
    return df


def awkward(spark: SparkSession, extra: bool = False) -> DataFrame:
    """Null and empty texts, a null id, repeated rows, blanks only, a very long text, odd characters."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    texts = [None, "", " \t\n ", "one", "one", long_text, "İstanbul ﬁne 🎉 text​ here", "a" * 50_000, "a normal text of some words, twice.", None]
    return docs(spark, texts, [1, 2, 3, 4, 4, 5, 6, 7, None, None], extra)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LABELS)
