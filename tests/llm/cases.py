"""Awkward tables that every operator must take: nulls, empty and very long texts, repeats, names that clash."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators might use themselves.
CLASHING = ["k1", "_k1", "_k2", "band", "node", "root", "digest", "file", "row", "key", "item", "window", "shard", "depth", "_text", "_lang", "_n", "_nll", "_n_words", "n_words", "quality", "words", "_file", "_row", "tok", "batch", "place"]
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "école", "straße", "x1", "42"]


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(3)
    long = prose(rng, 60_000)
    rows = [
        (1, "one two three four five", "en", "a", 23), (1, "one two three four five", "en", "a", 23), (2, "one two three four five", None, None, None),
        (3, "", "en", "a", 0), (3, "", "en", "b", 0), (4, None, "de", "a", None), (4, None, "de", "a", None), (None, None, None, None, None), (None, "one two three four five", "en", "a", 1),
        (None, "no id here", "fr", "a", 9), (None, "no id here", "fr", "a", 9), (5, long, "en", "a", len(long)), (6, long + " more", "en", "a", 1), (7, "   \n\t ", "es", "a", 6),
        (8, "...!!! ---", "en", "a", 10), (9, "é ü 😀  x", "xx", "a", 7), (10, "y" * 50_000, "en", "a", 50_000), (11, "tie", "en", "a", 3), (11, "other tie", "en", "a", 9),
    ]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de"]), "s", None) for i in range(30)]


def awkward(spark, rows: list[tuple] | None = None, clashing: bool = True):
    rows = awkward_rows() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.selectExpr("*", *[f"{'cast(null as string)' if i % 2 else 'doc_id'} as `{c}`" for i, c in enumerate(CLASHING)])
    return df


def empty(spark):
    return awkward(spark, [])


def labels(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(rows or [], "doc_id bigint, quality int, toxic int")


def table(df, *columns: str) -> list[tuple]:
    """Rows as sortable tuples."""
    columns = columns or tuple(df.columns)
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
