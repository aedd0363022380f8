"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, part int, __text string"


def odd_rows(seed: int = 1, n: int = 60):
    r = random.Random(seed)
    base = [r.choice(["alpha", "beta", "Gamma", "DELTA", "été", "ß", "x y", "naïve"]) for _ in range(300)]
    rows = [(None, "null id " * 20), (0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (5, "one two"), (6, "123 !!! ###"), (7, "word " * 3000)]
    for i in range(8, n):
        kind = i % 5
        if kind == 0:
            t = " ".join(base)
        elif kind == 1:
            w = list(base)
            w[r.randrange(300)] = "edit"
            t = " ".join(w)
        elif kind == 2:
            s = r.randrange(200)
            t = " ".join(base[s : s + r.randrange(20, 90)] + [str(r.random()) for _ in range(20)])
        elif kind == 3:
            t = " ".join(["a", "b"] * r.randrange(90))
        else:
            t = " ".join(str(r.randrange(10**6)) for _ in range(r.randrange(5, 80)))
        rows.append((i, t))
    rows += [rows[20], rows[20], (21, "another text under a repeated id " * 12)]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", None, len(t or ""), 1, 0.5, 2, "clash") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
