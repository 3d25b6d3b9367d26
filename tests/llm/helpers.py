"""Small inputs that hold the odd cases, and links by brute force."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ["key", "node", "hub", "component", "label", "h", "g", "at", "head", "line", "word", "n", "size", "host", "path", "row", "rate", "copies", "removed", "low_odds", "p_0", "part", "print"]


def table(spark, rows, extra=True):
    """documents of (doc_id, text) rows, with columns of clashing names."""
    df = spark.createDataFrame([(i, t, "en" if not i or i % 2 else "fr", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def words(n, seed=0, size=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def closure(nodes, pairs):
    """The smallest reachable node of each."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}
