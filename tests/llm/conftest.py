import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, keep_id int, group_size string, shard string, slot string, size string, target string, "
    "copies string, component_id string, digest string, rank string, score string, label string, item_id string, _key string, _copy string, taken string"
)
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "zeta", "Ünï", "omega", "kappa", "sigma", "rho", "tau", "psi", "chi"]


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, null ids."""
    base = words(120, 1)
    return [
        (1, base), (2, base.translate(str.maketrans("abcdefghij", "ABCDEFGHIJ"))), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "two words"), (9, words(30000, 2)),
        (10, "x" * 50000), (11, words(200, 3)), (11, words(200, 3)), (None, base), (None, None), (12, words(90, 4) + " " + base + " " + words(80, 5)), (13, "a" * 400), (14, "a" * 400),
        (15, "mail me at joe@mail.example.com or +1 (555) 555-0100"), (16, "one"), (17, "é" * 300), (18, words(150, 6)),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows with columns whose names operators use inside."""
    n = len(SCHEMA.split(", ")) - 5
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, *([None if k % 2 else 7] + [None if k % 2 else "x"] * (n - 1))) for k, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
