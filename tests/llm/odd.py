"""Rows that every operator has to take: nulls, empty and long texts, repeats, clashing extra columns."""

ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, score string"


def odd_docs(spark, texts=()):
    long_text = "word " * 20_000 + "x" * 30_000 + " the end"
    rows = [
        (1, "the cat sat on the mat by the door", "en", "a", 34, 7, "s", "q"),
        (1, "the cat sat on the mat by the door", "en", "a", 34, 7, "s", "q"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, 0, "", ""),
        (4, " \t\n ", "fr", "b", 4, 1, "s", "q"),
        (5, long_text, "de", "b", len(long_text), 1, "s", "q"),
        (None, "a row without an id", "en", None, 19, 1, "s", "q"),
        (6, "Café déjà vu 😀 — naïve ÀÉ", "fr", "c", 24, 1, "s", "q"),
    ]
    rows += [(100 + i, t, "en", "d", len(t), 1, "s", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


def no_docs(spark):
    return spark.createDataFrame([], ODD)
