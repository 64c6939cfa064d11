"""Documents with everything that may go wrong, and helpers for brute force."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, _row long"

WORDS = "the of and to in er that on thing ering anor was hein le la de que und der ein sch".split()


def rows(seed=0, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))
        out.append((i, text, rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "B", "é", None]), len(text), 0.5, "w", i))
    base = out[5][1] + " " + out[6][1]
    out += [(100 + i, base + (" x" if i % 2 else ""), "en", "a", 1, None, None, None) for i in range(6)]
    out += [
        (200, None, "en", "a", None, None, None, None),
        (201, "", "de", "b", 0, None, None, None),
        (202, " \t\n\x0b ", "fr", None, 5, None, None, None),
        (203, "... !!! 123", None, None, 11, None, None, None),
        (None, "the of and to in", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (204, "\U0001f600 АБ İstanbul ẞ ñ", "de", "é", 3, None, None, None),
        (205, "word " * 30_000, "en", "a", 150_000, None, None, None),
        (206, "x" * 5_000, "en", "b", 5_000, None, None, None),
        (207, "a", "en", "b", 1, None, None, None),
        (207, "a", "en", "b", 1, None, None, None),
        (208, "one text", "en", "b", 8, None, None, None),
        (208, "another text of the same id", "en", "b", 8, None, None, None),
    ]
    return out


def documents(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(n, linked):
    """Smallest index reachable from each, by a function that says whether two are linked."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if root[i] != root[j] and linked(i, j):
                    low = min(root[i], root[j])
                    high = max(root[i], root[j])
                    root = [low if r == high else r for r in root]
                    changed = True
    return root
