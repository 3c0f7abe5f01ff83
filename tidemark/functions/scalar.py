"""Scalar functions: bucket hash, fragment choice, vector distances, token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes to 0 under Spark's seed 42, so hash(SEED0, x) is Murmur3 of x with seed 0.
SEED0 = -1693959553
#: Letters with marks, and those that stand for them.
FOLDED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
METRICS = ("l2", "cosine", "dot")


def bucket(n: int, column: Column) -> Column:
    """(murmur3(value, seed 0) & 0x7fffffff) % n; null gives 0."""
    if n < 1:
        raise ValueError("bucket needs at least one bucket")
    return F.coalesce(F.hash(F.lit(SEED0), column).bitwiseAND(F.lit(0x7FFFFFFF)) % n, F.lit(0))


def fragment_or_rand(column: Column) -> Column:
    """The fragment id, or a random int where it is null (spreads inserted rows)."""
    return F.coalesce(column.cast("int"), (F.rand() * 2**32 - 2**31).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean distance, 1 - cosine, or 1 - dot product, in double precision."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "dot":
        return 1 - dot(a, b)
    raise ValueError(f"distance_type must be one of {METRICS}")


def tokens(text: Column, lower_case: bool = True, max_token_length: int | None = 40, base_tokenizer: str = "simple", stop_words: tuple[str, ...] = (), ascii_folding: bool = False) -> Column:
    """Tokens of a text in order: runs of letters and digits, or trigrams of them."""
    value = F.lower(text) if lower_case else text
    if ascii_folding:
        value = F.translate(value, *FOLDED)
    out = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if base_tokenizer == "ngram":
        grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
        out = F.flatten(F.transform(F.filter(out, lambda w: F.length(w) >= 3), grams))
    elif base_tokenizer != "simple":
        raise ValueError("base_tokenizer must be simple or ngram")
    if max_token_length:
        out = F.filter(out, lambda w: F.length(w) <= max_token_length)
    if stop_words:
        out = F.filter(out, lambda w: ~w.isin(*stop_words))
    return out
