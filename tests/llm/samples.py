"""Rows that operators have to bear."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with the names that operators use for their own.
CLASHES = "row string, ids string, score double, size long, kept string, k1 long, fingerprint string"
CLASHING = ("r", "i", 0.5, 7, "k", 1, "f")


def passage(first: int, n: int) -> str:
    """Words that stand in no other passage."""
    return " ".join(f"w{first + i}" for i in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, copies, repeated rows and ids, shared passages."""
    shared = passage(0, 60)
    long = passage(1000, 30_000)
    near = passage(50_000, 400)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, shared, "en", "a", 1),
        (5, passage(100, 20) + " " + shared + "\n" + passage(200, 5), "fr", "b", 2),
        (6, long, "en", "b", 3),
        (7, "the cat  sat", "en", "c", 12),
        (8, "the cat  sat", "en", "c", 12),
        (8, "the cat  sat", "en", "c", 12),
        (9, passage(300, 34), None, "c", 5),
        (10, passage(300, 34), None, "c", 5),
        (11, near, "en", "d", 6),
        (12, near + " tail", "en", "d", 6),
        (13, "na " * 300, "de", "d", 7),
        (14, "Ünï <|endoftext|> 　 日本語 x it's 12 \U0001f600", "de", "e", 8),
        (15, "12 34 !?", "es", "e", 8),
        (None, passage(300, 40), "en", "e", 9),
        (None, None, "en", None, None),
        (16, "a\x00b \x1c c\x85d", "en", "", 9),
    ]
    return rows
