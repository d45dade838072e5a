"""Small tables for the operator tests: nulls in every column, empty and very
long texts, ties, repeated rows, copies, and columns with clashing names."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, block string, n long"


def word(r):
    return "".join(r.choice(["an", "ti", "re", "ou", "ço", "ér", "lo", "x1"]) for _ in range(r.randint(1, 4)))


def prose(r, n, vocabulary=None):
    return " ".join(r.choice(vocabulary) if vocabulary else word(r) for _ in range(n))


def doc_rows(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = [word(r) for _ in range(400)]
    shared, passage = prose(r, 300, vocabulary), prose(r, 60, vocabulary)
    rows = []
    for i in range(n):
        t = prose(r, r.randint(1, 200), vocabulary)
        if i % 10 == 3:
            t = shared                                               # exact copies
        elif i % 10 == 4:
            w = shared.split()
            w[r.randrange(300)] = "other"                            # near copies
            t = " ".join(w)
        elif i % 10 == 5:
            t = f"{t} {passage} {prose(r, 40, vocabulary)}"          # a shared passage
        elif i % 10 == 6:
            t = "  Odd\n\n space \t here and　there  " + t.upper() + "!!"
        rows.append((i * 7, t, r.choice(["en", "fr", None]), r.choice(["a", "b", None]), len(t)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, "   \n ", "en", "a", 5),
             (None, "no id " + passage, "en", "a", 1), (1003, prose(r, 30_000, vocabulary), "fr", "a", 1),
             (1004, "same row twice " + prose(r, 50), "en", "b", 1), (1004, "same row twice " + prose(random.Random(1), 50), "en", "b", 1),
             (1005, "ab " * 200, "en", "b", 600), (1006, "one", "en", "b", 3), (1007, "1234 !!! 5678", "en", "b", 9)]
    rows.append(rows[-5])                                            # a repeated row
    return rows


def docs(spark, rows=None):
    rows = doc_rows() if rows is None else rows
    return spark.createDataFrame([(*r, "k", "_k", "b", 1) for r in rows], DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
