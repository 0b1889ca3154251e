"""Small tables of documents with the awkward cases."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \t\n", "word", "Été à la mer\nété", "A b  A b\r\nA b", "\n\n\n", "x" * 5000, "the cat " * 3000, "tab\tsep\x0bv\x0cf", "\U0001d11e ▁ x", "same text here", "same text here"]


def with_clashes(docs, *names):
    """docs with extra columns of the names that an operator adds."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("clash") for n in names})


def saved(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
