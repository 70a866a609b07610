"""Inputs that every operator on documents must survive, and plain versions to compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size string, kept int"

LONG = " ".join(f"wort{i % 700} the und {i}" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(30))


def documents(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, BASE, "en", "b", 9),
        (2, BASE, "en", "a", 9),
        (3, BASE.replace("alpha7 ", "omega "), "en", "a", 9),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \t\n ", "de", "b", 3),
        (7, LONG, "de", None, 1),
        (8, "one line of eight words that is here\nand another line\n\none line of eight words that is here", "en", "c", 1),
        (8, "one line of eight words that is here\nand another line\n\none line of eight words that is here", "en", "c", 1),
        (None, "the text of a row without an id\none line of nine words that is here too", "en", "c", 1),
        (9, "1234 5678 ... !!", "en", "b", 1),
        (10, "zwei\x0bwörter ünd ß\r\nthe end", "de", "b", 1),
        *extra,
    ]
    return spark.createDataFrame([(*r, 0.5, "x", "y", 1) for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)
