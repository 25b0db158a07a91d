import pytest


@pytest.fixture(scope="session")
def docs():
    """Some invented documents with copies, near copies, shared passages and odd texts."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = text(70)
    rows = [(i, text(rng.randint(20, 300)) + ("\n" + text(12)) * (i % 3), ["en", "de"][i % 2], f"src{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0") for i in range(5)]  # exact copies
    rows += [(110 + i, rows[20 + i][1].replace(" ", " zz ", 1), "en", "src0") for i in range(5)]  # near copies
    rows += [(120 + i, text(40) + " " + shared + " " + text(40), "en", "src1") for i in range(4)]
    rows += [(130, None, None, None), (131, "", "en", None), (132, " \n\t ", "en", "src0"), (133, "é ü 漢字 😀 <turn user>\\l <|endoftext|>", "en", "src2"), (134, text(30_000), "en", "src3"), (1, rows[1][1], "de", "src1")]
    return rows


@pytest.fixture(scope="session")
def table(spark, docs):
    return spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, source string, d string")
