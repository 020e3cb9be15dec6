from __future__ import annotations

import pytest

#: Names that operators could use for columns of their own.
CLASHES = ["id", "h", "n", "row", "block", "piece", "node", "key", "draw", "part", "slot", "copies", "n_words", "kept", "score", "__text", "__words", "hot", "gram"]


@pytest.fixture
def make(spark):
    """A documents table with clashing extra columns from (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES))

    return build


LONG = "the cat sat on a mat and the dog did not " * 3000


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and unusual characters."""
    return [
        (1, "a small text of seven words here"), (2, None), (3, ""), (4, "   \n\t "), (None, "no id at all"), (None, None), (5, "twice the same row"), (5, "twice the same row"), (6, "twice the same row"),
        (7, LONG), (8, "naïve façade — 日本語 🎉 <|endoftext|> Σίσυφος ½ ٣"), (9, None, None, None), (10, "x\x00y ​ z", None, None), (-3, "negative id"), (2**62, "large id"),
    ]
