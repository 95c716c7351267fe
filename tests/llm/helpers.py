"""Small tables with the odd cases every operator must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

TEXTS = [
    (1, "One two three four five six seven eight nine ten."),
    (2, "one two three four five six seven eight nine ten."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "short"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "Zwei Wörter, über alles.\nNeue Zeile\n\nund noch eine"),
    (10, "emoji 😀 中文 ſ İ é \x0b x\x0cy <|endoftext|>"),
    (6, "short"),
    (None, "a row without an id"),
]


def documents(spark, rows=TEXTS):
    """Documents with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ("lang", "source", "n_chars", "score", "n", "rate", "shard", "slot", "label", "cid", "Times", "h", "part", "pos", "ids")
    return df.withColumns({c: F.lit("x") for c in extra})


def empty_documents(spark):
    return documents(spark).limit(0)
