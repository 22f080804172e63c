"""Small awkward tables that every operator has to survive."""

import random

from pyspark.sql import functions as F

WORDS = "the of and tion thre ing able hea ouen stor lyn rent qua mis der por".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


LONG = "\n".join(prose(1000 + i, 60) for i in range(400))


def texts() -> list[tuple]:
    """(doc_id, text): nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    near = prose(1, 120)
    return [
        (1, near), (2, near), (3, near.replace("the", "teh", 1)), (4, prose(2, 90)), (5, prose(3, 80)), (6, None), (7, ""),
        (8, " \t\n "), (9, "one two"), (10, "one two"), (11, LONG), (12, LONG + " end"), (13, prose(2, 90)),
        (4, prose(2, 90)), (14, prose(4, 70)), (14, prose(5, 70)), (None, near), (None, None), (15, "\x0b é日本\r\n" * 3),
        (-3, prose(6, 50)),
    ]


def frame(spark, rows=None, types="doc_id long, text string"):
    """The rows with extra columns whose names clash with the operators' own, some of them all null."""
    df = spark.createDataFrame(texts() if rows is None else rows, types)
    for name in ("doc", "version", "node", "key", "keep", "start", "end", "n", "LD_doc", "jj_keep", "dc_doc", "component",
                 "label", "score", "n_lines"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df
