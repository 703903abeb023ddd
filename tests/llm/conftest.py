from __future__ import annotations

import pytest

LONG = "gamma delta " * 4000 + "end"
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of five words here.", "a"),
    (2, "", "a"),
    (3, None, None),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of five words here.", "b"),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of five words here.", "b"),
    (5, LONG, "b"),
    (6, "  \n\t ", "c"),
    (7, "one two", "c"),
    (None, "no id but nine words of text to read here", "c"),
    (9, "żółć — ΑΣ  x y\n\n1.5  it's I'll", "d"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, a repeated row, and columns with names operators use inside."""
    rows = [(i, t, s, len(t or ""), "x", 1.0, 7, *range(12)) for i, t, s in TEXTS]
    clashing = ", ".join(f"{c} int" for c in (
        "epochs", "skipped", "_key", "times", "_k", "_stay", "_lines", "_h1", "_row", "target", "id", "n"))
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, lang string, score double, cell int, "
        + clashing).coalesce(1)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
