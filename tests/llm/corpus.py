"""Small corpora with repeats, and awkward rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 40) -> list[tuple[int, str]]:
    """Texts with shared passages, near copies and exact copies."""
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (12, 20, 33, 60)]
    docs: list[list[str]] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and docs:
            docs.append(list(rng.choice(docs)))
        elif kind < 0.45 and docs:
            d = list(rng.choice(docs))
            for _ in range(3):
                if d:
                    d[rng.randrange(len(d))] = f"x{rng.randrange(10**6)}"
            docs.append(d)
        else:
            d = prose(rng, rng.randrange(0, 120))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(d) + 1)
                d[at:at] = rng.choice(shared)
            docs.append(d)
    return [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)]


def rows(docs):
    return [(i, t, "en", "a", len(t) if t is not None else None) for i, t in docs]
