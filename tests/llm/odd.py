"""Rows that no operator may stumble over."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, same string, size int, component long, hot double, label string, `from` int"
LONG = "word " * 30000 + "x" * 70000
PROSE = " ".join(f"w{i}" for i in range(80))


def odd_documents(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with names that operators use inside."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, PROSE), (6, PROSE), (6, PROSE), (None, PROSE), (None, None), (7, "a b c"), (8, "A B c"), (9, "é\u0085ß 😀\n\né"), (10, LONG + " tail")]
    rows = [(i, t, None, "s" if i and i % 2 else None, None, "k", 1, "s", 2, 3, 4.0, "l", 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
