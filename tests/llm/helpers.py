"""Fixture rows and brute-force forms shared by the tests of the text operators."""

import re
import zlib

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, ids string, shard string"
#: Nulls in every column, empty and blank texts, a long text, repeated rows, equal texts, clashing columns.
ROWS = [
    (1, "the cat sat on the mat and then the dog came in and sat there too", "en", "a", 10, "x", "y", "z", "w"),
    (1, "the cat sat on the mat and then the dog came in and sat there too", "en", "a", 10, "x", "y", "z", "w"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None, None, None),
    (4, " \n\t ", "fr", None, 3, None, None, None, None),
    (5, "un deux trois quatre cinq six sept huit neuf dix onze douze", "fr", "b", 5, None, None, None, None),
    (6, "word " * 30_000 + "end", "en", "b", 1, None, None, None, None),
    (None, "no id but a text of more than ten words so that it passes the rule", "en", "c", 1, None, None, None, None),
    (7, "x", None, "c", 1, None, None, None, None),
    (8, "x" * 20_000, "en", "c", 1, None, None, None, None),
    (9, "un deux trois quatre cinq six sept huit neuf dix onze douze", "fr", "b", 5, None, None, None, None),
    (10, "été 中文 😀 #%&|<>   a", "fr", "b", 5, None, None, None, None),
]


def odd_documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def grams(text, n=5):
    found = words(text)
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1)) or (frozenset([tuple(found)]) if found else frozenset())


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n
