"""Fixtures of the text operator tests (imported there by name)."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and an extra column named as operators name theirs."""
    base = " ".join(f"Word{k}" for k in range(400))
    edited = base.replace("Word200", "other")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, edited, "en", "c"), (4, "", "en", "a"), (5, None, "en", "b"),
        (6, "one two", "de", None), (6, "one two", "de", None), (7, "ONE two", None, "c"), (8, " \t\n ", "en", "a"),
        (None, base, "en", "a"), (None, "lone words here", None, None), (9, "x" * 100_000, "en", "b"),
        (10, " ".join(f"w{k % 7}" for k in range(20_000)), "en", "a"), (11, "line one\nline one\nline two", "fr", "c"),
        (12, "line one\nother", "fr", "b"), (13, "über straße naïve ß\u00a0z\u2003y \x1c q", "de", "a"),
        (2, base, "en", "b"), (14, "start " + base + " end", "en", "d"),
        (15, "\n".join(f"line {k % 30_000}" for k in range(100_000)), "en", "e"),  # very many lines
        (16, base + " one more", "en", "a"), (16, " ".join(f"else{k}" for k in range(60)), "en", "a"),  # one id, two texts
    ]
    clash = ("clash", 0, 7, 8, "kept", 9, 10, 11, "component", "line", 12, 0.5)
    rows = [(*r, len(r[1] or ""), *clash) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, size int, n_lines long, n_words int, "
              "kept string, n_removed long, word_chars int, n_symbols int, component string, line string, copies int, target double")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
