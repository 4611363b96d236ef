"""Small tables shared by the tests: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, ROW_ string, id string"


def prose(n, seed=1, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))


def edge_texts():
    long = prose(9000, 5)
    return [
        None, "", " \n\t ", "a", "Hello World", "hello world", "HELLO WORLD", long, long + ".", long.upper(), prose(60, 2), prose(60, 2) + " tail",
        "é ü ß " * 30, "x" * 300, "the cat " * 80, prose(120, 3) + "\n" + prose(120, 3), "tab\tand\x0bvt\x0cff\r\nnl", " nbsp em", "𝄞 clef " * 20, "a\\b'c\"d",
    ]


def edge_rows():
    rows = [(i, t, "en", ("b", "a", None, "ü")[i % 4], len(t or ""), 7, "x", "y") for i, t in enumerate(edge_texts())]
    return rows + [rows[4], rows[7], (None, "no id", "en", "a", 5, 7, "x", "y"), (4, "same id, other text", "en", "a", 5, 7, "x", "y")]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def unique_docs(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or ""), 7, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
