"""Rows that every operator must bear: NULLs, empty and long texts, ties, repeated rows, columns with clashing names."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "Two Words",
    "é̂ 1२३ 😀 😀😀 ß",
    "a\x1c b\x85 c d  e",
    "  a  b\n\n c \t d ",
    "<|endoftext|> hi<|endoftext|><|im_end|>\n<|im_start|>assistant\nok <\\|x|> <\\\\|",
    "don't we'll 'S 12345 ### !!!\r\nnext\nline\n",
    "lorem ipsum dolor " * 3000,
    "x" * 5000,
]


def odd_documents(spark, extra: tuple = ()):
    """Every odd text twice under one id, once more without an id, with and without source and language."""
    rows = []
    for i, text in enumerate(ODD_TEXTS):
        lang, source = (None if i % 3 == 0 else "en"), (None if i % 4 == 0 else f"s{i % 5}")
        rows += [(i, text, lang, source, len(text or ""))] * 2 + [(None, text, lang, source, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name in extra:
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit("extra"))
    return docs


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
