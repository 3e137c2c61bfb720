"""Rows that every operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
EXTRA = ("key", "keep", "bucket", "group", "length", "rep", "hi", "lo", "piece", "bin", "place", "begin", "end", "window", "original", "score", "stats", "y", "held", "at", "total", "tokens", "words", "spans", "a", "b", "m", "count", "row")
WORDS = {
    "en": "the of and to in is for that with on as by was it time house river stone garden letter window morning paper simple answer".split(),
    "de": "der die und in den von zu das mit sich haus fluss stein garten brief fenster morgen papier antwort einfach über straße".split(),
    "fr": "de la le les et des en un du une maison rivière pierre jardin lettre fenêtre matin papier réponse simple été à".split(),
}


def prose(seed, n, lang="en"):
    pick = random.Random(seed)
    made = lambda: "".join(pick.choice(WORDS[lang][14:])[:4] for _ in range(2)) + "".join(pick.choice("aeioulnrst") for _ in range(3))
    return " ".join(pick.choice(WORDS[lang]) if pick.random() < 0.5 else made() for _ in range(n)).capitalize() + "."


def edge_rows():
    long = prose(1, 30_000)
    shared = prose(2, 60)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "...", "en", "a", 3), (5, "a", "en", "a", 1), (None, prose(3, 80), "en", "a", 1), (None, prose(3, 80), "en", "a", 1),
        (None, None, None, None, None), (7, prose(4, 90), "en", "b", 1), (7, prose(4, 90), "en", "b", 1), (8, prose(4, 90), "en", "b", 1), (9, long, "en", "b", 1), (10, prose(5, 40) + " " + shared, "en", "c", 1),
        (11, shared + " " + prose(6, 40), "en", "c", 1), (12, "日本語のテキスト " * 40, "ja", "c", 1), (13, "😀" * 300, "xx", "c", 1), (14, "x" * 50_000, "en", "c", 1), (15, "word " * 400, "en", "c", 1), (15, prose(7, 70, "de"), "de", "c", 1),
        (16, prose(8, 100, "fr"), None, "c", 1), (17, "Released under the MIT License.", "en", "d", 1), (-5, "All rights reserved. All rights reserved.", "en", "d", 1),
    ]


def edge_docs(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)} | {"when": F.lit("2024-01-01").cast("timestamp"), "more": F.create_map(F.lit("k"), F.lit(1))})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
