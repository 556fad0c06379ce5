"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
#: Columns whose names operators use inside.
CLASHES = ("key", "digest", "n", "left", "_row", "c0", "k0", "_text", "start", "node", "component", "score", "_n_lines", "_removed", "length", "rank", "i", "j", "_id", "runs")


def awkward(spark, rows):
    """Documents of (doc_id, text) with the usual columns, null in some, and clashing ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s")).withColumn("n_chars", F.lit(None).cast("long"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


def texts(path="/root/testdata/sf0.001"):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))


ODD_TEXTS = ["", " ", "\n\n \t", "don't  we'll 'tis 're'v'l", "a" * 3000, " " * 400 + "x", "x<|endoftext|>y <|endoftext|>", "中文 😀 é́ İ ǅ \x1c\x85\xa0b", "١٢٣ ²³ ½", "~0<~1|<|im_end|>\n~2", "tab\tnew\r\nline", "ΑΣ ΣΑΣ ß ŉ", LONG]
