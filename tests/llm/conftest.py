import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(seed, lines=4, words=12):
    rng = random.Random(seed)
    stems = [a + b for a in ("ba", "co", "di", "fu", "gre", "hal", "in", "jo") for b in ("", "ra", "nté", "lous", "m", "sk")]
    return "\n".join(" ".join(rng.choice(stems) for _ in range(words)) + "." for _ in range(lines))


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, copies and near copies."""
    rows = [(k, sentences(k), ("en", "fr", None)[k % 3], ("src1", "src0", None)[k % 3 if k % 5 else 1], 0) for k in range(24)]
    copy = rows[3][1]
    rows += [
        (30, copy, "en", "src0", None),
        (30, copy, "en", "src0", None),  # a repeated row
        (31, copy.replace("co", "zz", 1), "en", "src0", 1),
        (32, None, None, None, None),
        (33, "", "en", "src0", 0),
        (34, " \t\n\x0b\x0c\r ", "en", "src0", 7),
        (35, "one", "en", "srcé", 3),
        (36, "one two", None, "src0", 7),
        (None, sentences(5) + "\n" + sentences(99), "en", "src1", 1),
        (None, None, "en", "src1", 1),
        (37, sentences(7, 300, 40), "en", "src1", 1),
        (38, "# * $ | " * 60, "en", "src1", 1),
        (39, ("same words again here " * 40).strip(), "fr", "src1", 1),
        (40, "日本語 テキスト ▁ é 😀 <s> \x00 x  y   ", "ja", "src1", 1),
        (41, "\n".join(["a line that comes twice here"] * 2 + ["another"]), "en", "src1", 1),
        (42, sentences(3)[:90] + sentences(98) + sentences(4)[20:120], "en", "src0", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({"size": F.lit("x"), "ids": F.lit(1), "n": F.lit(2), "host": F.lit(3), "score": F.lit(4), "line": F.lit(5), "rule": F.lit(6)})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
