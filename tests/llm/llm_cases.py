"""Documents with everything that an operator has to stand."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, kept boolean, n long, size int, key string, rid string, norm string, digest string, label string, part int, n_tokens string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["the", "and", "er", "ing", "tion", "ou", "re", "st"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    base = prose(80).split(" ")
    rows: list[tuple[int | None, str | None, str | None]] = [(k, prose(rng.randint(12, 90)), rng.choice(["en", "de"])) for k in range(60)]
    # near copies: one word changed each; exact copies but for case
    for k in range(60, 80):
        copy = list(base)
        copy[(k * 7) % len(copy)] = f"changed{k}"
        rows.append((k, " ".join(copy), "en"))
    rows += [(k, " ".join(base).upper() if k % 2 else " ".join(base), "en") for k in range(80, 86)]
    rows += [
        (100, None, "en"), (101, "", "en"), (102, "   \n\t ", None), (103, "one two", "en"), (104, "ONE two", None), (105, "<|endoftext|> a b 中文 \U0001f642 é", "zh"),
        (106, "x" * 30000 + " y", "en"), (107, prose(9000), "en"), (108, "line one\nline one\n\nline two " + "again and again and again and again and again " * 4, "de"),
        (None, "no id here but words enough to be kept as one of the rows", None), (109, None, None), (110, "#$% *** &&& | < > " * 5, "fr"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]),
    ]
    return rows


def frame(spark, rows=None):
    data = texts() if rows is None else rows
    return spark.createDataFrame([(*r, "s", 1, 3, True, 4, 5, "k", "r", "m", "d", "l", 6, "t") for r in data], SCHEMA).repartition(3)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {p for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(inside)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str) -> set:
    words = WORD.findall(lower(text))
    return set(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows) -> dict:
    """Smallest doc_id reachable by links, from all pairs."""
    held = [(i, shingles(t or "")) for i, t, *_ in rows if i is not None]
    label = {i: i for i, _ in held}
    changed = True
    pairs = [(a, b) for a, x in held for b, y in held if a < b and x and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
