"""Small tables that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

ODD = [
    (1, "the cat sat on the mat", "en"),
    (2, "", "en"),
    (3, None, None),
    (4, "the cat sat on the mat", "en"),
    (4, "the cat sat on the mat", "en"),
    (None, "no identifier here at all", None),
    (5, "word " * 5000, "en"),
    (6, " \t\n ", "de"),
    (7, "é — ßtraße \U0001f600 naïve 中文 123 <|endoftext|> it's", "fr"),
]


def documents(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        df = df.selectExpr("*", "1 as n_tokens", "'x' as block", "'y' as score", "2 as fingerprint", "'s' as source")
    return df
