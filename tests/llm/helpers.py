"""Small tables with the awkward rows every operator has to bear."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """A documents table from (doc_id, text), with columns whose names the operators also use inside."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    table = spark.createDataFrame(full, DOCS)
    return table.select("*", *[F.lit(7).alias(n) for n in ("_row_id", "_text", "rep", "h", "doc", "place", "row", "body")])


def words(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(count)]


def awkward(seed=1):
    """Null, empty and blank texts, copies, near copies, shared passages, a long text and a null id."""
    base, passage = words(seed, 160), words(seed + 1, 70)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, " ".join(base)), (7, " ".join(base))]
    for k in range(8):
        edited = list(base)
        for at in range(k, len(edited), 23 - 2 * k):
            edited[at] = f"x{k}{at}"
        rows.append((10 + k, " ".join(edited)))
    for k in range(6):
        rows.append((30 + k, " ".join(words(50 + k, 40 + 9 * k) + passage[k:] + words(70 + k, 33))))
    rows.append((40, "\n".join(words(5, 60) * 3)))
    rows.append((41, " ".join(words(6, 9000, 90000))))
    rows.append((42, "é" * 900 + " ünïcode " + "=" * 700))
    rows.append((None, " ".join(base)))
    return rows
