"""Documents with every awkward row the operators must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = "words long, version long, fp long, n_words long, rank long, size int, bucket int, others string, kept boolean"

WORDS = ["the", "of", "and", "stone", "river", "cloud", "lamp", "été", "straße", "niño", "x", "12", "don't", "re-do", "a.b"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def edge_rows() -> list[tuple]:
    passage = prose(900, 80)
    rows = [
        (1, prose(1, 120) + " " + passage, "en", "a", 1),
        (2, passage + "\n" + prose(2, 90), "en", "a", 1),
        (3, prose(3, 60) + "\t" + passage + "  " + prose(4, 40), "en", "b", 1),
        (4, prose(1, 120) + " " + passage, "en", "b", 1),
        (4, prose(1, 120) + " " + passage, "en", "b", 1),
        (5, None, None, None, None),
        (6, "", "en", "c", 0),
        (7, " \n\t ", "en", None, 4),
        (8, "one two three", "en", "c", 13),
        (9, "same " * 300, "en", "c", 1500),
        (10, prose(5, 30_000), "en", "d", 1),
        (11, "x" * 200_000, "en", "d", 200_000),
        (12, "\U0001f642 中文 <|endoftext|> don't 'tis we'll ''s ½ Σας", "xx", "d", 10),
        (None, prose(6, 70), "en", "a", 1),
        (None, passage, "en", None, 1),
        (13, prose(7, 55) + " " + prose(7, 55), "en", "a", 1),
        (13, prose(8, 70), "en", "a", 1),
        (14, "Released under the MIT License.\nmit LICENSE mit-license", "en", "a", 1),
    ]
    return rows


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA)


def clashing_docs(spark: SparkSession) -> DataFrame:
    extra = (None,) * len(CLASHES.split(", "))
    return spark.createDataFrame([row + extra for row in edge_rows()], f"{SCHEMA}, {CLASHES}")


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain_rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows in an order that nulls and repetitions can't disturb."""
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=lambda row: tuple((v is None, str(v)) for v in row))
