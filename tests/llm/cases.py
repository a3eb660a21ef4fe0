"""Small tables with the cases that every operator must bear."""

import random

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    syllables = "ba de fi go ku la me ni po ru sa te vi wo xu za".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


def edited(text: str, every: int) -> str:
    words = text.split(" ")
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))


def odd_rows():
    base = prose(300, 1)
    return [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "b", len(base)),
        (2, base, "en", "b", len(base)),
        (3, edited(base, 60), "en", "a", 0),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, "", "en", "a", 0),
        (None, prose(120, 2), "fr", None, 3),
        (None, prose(120, 2), "fr", "c", 3),
        (7, "one", "en", "a", 3),
        (8, "!!! ... ???", "en", "a", 3),
        (9, prose(40_000, 3), "en", "a", 3),
        (10, "é à ü — 漢字 😀 " * 40, "de", "c", 3),
        (11, prose(200, 4), "en", "b", 3),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The odd rows with extra columns named like those that operators make."""
    names = "row uid group at size prefix full m keep reason node bucket duplicate_of key seq shard slot block Text DOC_ID c0".split()
    schema = T.StructType(T._parse_datatype_string(SCHEMA).fields + [T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([(*r, *names) for r in odd_rows()], schema)
