"""Rows for the corpus tests."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=""):
    """(doc_id, text[, lang, source]) rows as documents, with optional extra columns of value 7."""
    full = []
    for r in rows:
        i, text, lang, source = (*r, "en", "s0")[:4] if len(r) < 4 else r[:4]
        full.append((i, text, lang, source, None if text is None else len(text)) + ((7,) * len(extra.split(",")) if extra else ()))
    return spark.createDataFrame(full, SCHEMA + (", " + extra if extra else ""))


#: Nulls in every column, empty and white-space texts, a very long one, ties and repeated rows.
ODD = [(1, None, None, None), (2, "", "en", "s0"), (3, " \n\t ", "en", "s0"), (None, "a null id stays here", "en", None), (4, "The the THE thé é中文 \U0001f600 x" * 3, "fr", "s1"), (5, "word " * 60_000, "en", "s1"), (6, "twice the same row", "de", "s2"), (6, "twice the same row", "de", "s2"), (7, "twice the same row", "de", "s2"), (8, "x" * 300_000, "en", "s2")]
CLASHES = "h long, row long, node long, score long, __size long, seeds long, y long, at long"
