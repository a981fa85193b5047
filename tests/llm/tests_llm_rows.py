"""A small corpus with cases for each stage of the pipeline."""

import random


def corpus():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    text = lambda n=120: " ".join(rnd.choice(vocabulary) for _ in range(n))
    one, two = text(), text()
    rows = [(i, text(rnd.randint(60, 200))) for i in range(300)]
    rows += [(500, "too short"), (501, None), (502, ""), (600, one), (601, one + " more"), (602, text()), (603, two), (603, two), (None, text())]
    rows += [(700, text() + " " + " ".join(f"bench{i}" for i in range(12))), (800, text() + " password=hunter22 end")]
    return [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows]
