import pytest


@pytest.fixture
def documents(spark):
    """(doc_id, text, lang, source) rows as a table with the columns of documents and a clashing extra one."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "n_chars as size", "source as shard", "source as band", "n_chars as target")

    return make


@pytest.fixture
def prose():
    """A generator of invented texts from a fixed seed."""
    import random

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    return lambda n, r=rng: " ".join(r.choice(vocabulary) for _ in range(n))
