import random

import pytest


def prose(seed, words):
    rng = random.Random(seed)
    parts = ["an", "ther", "ing", "on", "ed", "ha", "re", "tion", "wh", "st"]
    text = [rng.choice(parts) + rng.choice(parts) + rng.choice(["", rng.choice(parts)]) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(text))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls everywhere, empty and long texts, copies, near copies, repeated
    rows, a hot source and extra columns whose names clash with helper columns."""
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    token = "0123456789" + "abcdef98765432100f"
    passage = prose("passage", 70)
    rows = [
        (None, None, None, None, None), (1, None, "en", "s0", None), (2, "", "en", None, 0), (3, "   \n\t", None, "s0", 4),
        (4, "123 456 !!", "en", "s0", 10), (None, prose(1, 40), "en", "s0", 1), (5, prose(2, 3000), "en", "s0", 1),
        (6, prose(3, 60) + f" token = \"{token}\" and {key}x password=short", "en", "s1", 1),
        (7, "mail a.b@c.de, b@x@y.org 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 +1 (415) 555-2671 or 4111 1111 1111 1111", "de", "s1", 1),
        (8, "token=token: abcdefg secret=\u212a12345678 a@b.c_d@e.f é5555555555554444", "fr", "s2", 1),
        (9, "9" * 5000 + " " + "a" * 5000 + " " + "a.b" * 2000 + "@" + "x." * 3000 + "y", "en", "s0", 1),
        (10, passage, "en", "s0", 1), (11, prose(4, 30) + ". " + passage + " " + prose(5, 30), "en", "s3", 1),
        (12, passage + "\n" + passage, "en", "s4", 1), (5, prose(2, 3000), "en", "s0", 1), (5, prose(6, 20), "en", "s0", 1),
        (13, "a b", "en", "s0", 1), (14, "A  B", "en", "s1", 1), (15, "x", "en", "s1", 1), (16, "İstanbul ΟΔΥΣΣΕΥΣ don't <|endoftext|> \x1c ok", None, "s1", 1),
    ]
    rows += [(100 + i, prose("copy", 120), "en", "s0", 1) for i in range(15)]
    rows += [(200 + i, prose("near", 150) + f" {prose(i, 1)}{i}", "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(300 + i, prose(100 + i, 30 + i) + f" key{i}" + "QwertyUiop1234567", "en", f"s{i % 5}", 1) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for name in ("row", "key", "hash", "spans", "token", "_text", "class_id"):
        frame = frame.selectExpr("*", f"concat('{name}', doc_id) AS `{name}`")
    return frame.repartition(5)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
