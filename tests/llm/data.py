"""Rows with every odd case, in a table whose other columns have the operators' own names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, key double, size long, slice int, __id long, score double, __score double, fp long, h long, template long, copies int"


def edge_rows():
    long = "long words of text " * 5000
    return [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n", "de", "b", 3), (4, "One", "en", "a", 3), (4, "One", "en", "a", 3), (None, "no id here", "fr", "c", 10), (None, None, None, None, None), (7, long, "en", "a", 1), (6, long, "en", "b", 1), (8, "naïve \U0001f600 text\x0b with odd\x0cspaces", "es", "c", 9), (9, "a b c d e f g h i j", "en", "a", 19), (10, "a b c d e f g h i j", "en", "c", 19)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 2, 3, 4, 0.1, 0.2, 5, 6, 7, 8) for r in rows], SCHEMA).repartition(3)
