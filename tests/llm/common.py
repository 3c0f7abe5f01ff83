"""A small table of documents with every awkward case."""

from pyspark.sql import types as T

SCHEMA = (
    T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
    .add("size", "string").add("n", "string").add("key", "string").add("a", "string").add("component", "string").add("text_id", "string")
)
WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("ing" if x % 7 == 0 else ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    long = prose(3, 30_000)
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, prose(1, 40)), (5, prose(1, 40)), (5, prose(1, 40)), (6, prose(1, 40) + " extra"), (7, "one two"), (8, "One  TWO"),
        (9, long), (10, long + " end"), (None, prose(2, 12)), (None, None), (11, "été Ünïcode 日本語 テスト 😀 a\x00b"), (12, prose(7, 6)), (13, prose(7, 6).rsplit(" ", 1)[0]),
        (14, prose(8, 300)), (15, prose(8, 300).replace(" ", "\n")),
    ]
    return [(i, t, "en" if k % 2 else None, [None, "s1", "s2"][k % 3], len(t or ""), "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
