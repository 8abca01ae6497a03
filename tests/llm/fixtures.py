"""Small tables that hold the awkward cases."""

import random
import string

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]


def awkward_texts(seed=1, rows=60):
    """Texts with copies, near copies, shared passages, repeats, nulls and very short and long rows."""
    rng = random.Random(seed)

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(string.ascii_lowercase) for _ in range(n))

    passage, base = prose(30), prose(80)
    out = []
    for n in range(rows):
        kind = n % 10
        if kind == 0:
            text = None if n % 20 else ""
        elif kind == 1:
            text = base
        elif kind == 2:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = prose(20) + "\n" + passage + "\t" + prose(15)
        elif kind == 4:
            text = " \t\n "
        elif kind == 5:
            text = (prose(7) + " ") * 6
        elif kind == 6:
            text = "ab " * 150 + prose(3)
        elif kind == 7:
            text = "é" * 130 + " " + "x" * 260
        elif kind == 8:
            text = prose(4)
        else:
            text = prose(200) + " " + passage.upper()
        out.append((rng.randrange(10_000), text))
    out.append((out[1][0], out[1][1]))
    out.append((out[3][0], "same id, other text " + passage))
    out.append((None, passage + " " + base))
    out.append((None, passage))
    out.append((3, prose(3000) + " " + passage))
    return out
