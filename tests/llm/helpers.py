"""Fixtures of awkward documents, shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, region long, label binary, _again int"


def words(n, seed, letters="abcdefghijklmnop", least=2, most=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n))


def frame(spark, rows):
    """doc_id, text, lang, source rows as documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, l, s, None if t is None else len(t), "x", 1, b"y", 2) for d, t, l, s in rows], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    a = words(60, 1)
    rows = [
        (1, a, "en", "s0"), (1, a, "en", "s0"), (2, a, "en", None), (3, None, "en", "s1"), (4, "", None, "s1"), (5, "   \n ", "en", "s1"),
        (None, a, "en", "s0"), (None, words(40, 2), None, None), (6, words(60000, 3), "en", "s2"), (7, "x", "en", "s2"), (8, "1234 5678", "en", "s2"), (9, "¡ñandú! 日本語 テスト", "es", "s2"),
    ]
    return frame(spark, rows)


def empty(spark):
    return frame(spark, [])
