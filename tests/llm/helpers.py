"""Awkward rows that every operator must take: nulls, blanks, ties, repeats, extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long"


def frame(spark, texts, ids=None, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "s", None if t is None else len(t), 7, "x", 1) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def docs_dir(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
