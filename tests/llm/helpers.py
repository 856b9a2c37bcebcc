"""Brute-force counterparts and awkward tables for the operators on documents."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text, n=5):
    found = words(text)
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a repeated id, and columns named like outputs."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "été", "x1"]) for _ in range(30_000)) + "!" * 3000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "s", 1),
        (1, "The quick brown fox jumps over the lazy dog", "en", "s", 1),
        (1, "another text with this id", None, None, None),
        (None, "no id at all", "en", "s", 1),
        (2, None, "en", None, 3),
        (3, "", None, "s", None),
        (4, " \n\t ", "en", "s", 0),
        (5, long, "en", "s", 9),
        (6, "12 34 ... !!", None, "s", 2),
        (7, "Ünïcode — ẞ 漢字 🙂  \x1c end", "de", "s", 3),
    ]
    extra = ", n_tokens string, ids string, n_hit string, score string, row string, class_id string, lang_pred string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA + extra)


def empty(spark):
    return awkward(spark).where("false")


def corpus(spark, sizes, seed=1):
    """Random texts of the given numbers of words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in sizes]
