"""Small documents with every odd case that operators must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("the", "re", "ing", "on", "ti", "Ha", "é", "ß") for b in ("st", "an", "ly", "or", "X", "ñ")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "", "", ".", ","])) for _ in range(n))


def documents() -> list[tuple]:
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(99, 60)
    texts = [
        (1, base), (2, base), (3, near), (4, prose(2, 80)), (5, None), (6, ""), (7, "  \t\n "), (8, "single"), (9, "single"),
        (10, prose(3, 40) + " " + passage + " " + prose(4, 30)), (11, prose(5, 20) + "\n" + passage + "\t" + prose(6, 50)),
        (12, prose(7, 30_000)), (12, prose(8, 15)), (4, prose(2, 80)), (None, base), (None, prose(9, 25)), (13, base.upper()),
        (14, "a b   c\x0bd\x0ce \x1cf \U0001f600g"), (15, passage), (16, prose(10, 13)), (17, prose(10, 13)), (18, prose(10, 12)), (19, prose(10, 12)),
        (20, "x " * 400),
    ]
    return [(d, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None) for k, (d, t) in enumerate(texts)]
