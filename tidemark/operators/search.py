"""Vector, full-text and hybrid search as DataFrame plans.

Scores are BM25 with table-wide statistics: idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
tf (k1 + 1) / (tf + k1 (1 - b + b length / average)), k1 = 1.2 and b = 0.75 (Robertson
and Zaragoza 2009).  Distances are squared Euclidean, 1 - cosine or 1 - dot product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import FOLDED, METRICS, distance, tokens

K1, B = 1.2, 0.75


def _check(k: int, offset: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if offset < 0:
        raise ValueError("offset must not be negative")


def _columns(df: DataFrame, columns, hidden: tuple[str, ...]) -> list[str]:
    own = [c for c in df.columns if c not in hidden]
    if columns is None or columns == "*" or list(columns) == ["*"]:
        return own
    by_lower = {c.lower(): c for c in own}
    out = []
    for c in columns:
        if c.lower() not in by_lower:
            raise ValueError(f"unknown column {c}")
        out.append(by_lower[c.lower()])
    return out


def vector_search(
    df: DataFrame, query_vector: list[float], k: int = 10, vector_column: str = "vector", distance_type: str = "l2", columns=None, filter: str | None = None,
    offset: int = 0, row_id: str = "_rowid", with_row_id: bool = False, prefilter: bool = True, lower_bound: float | None = None, upper_bound: float | None = None,
    nprobes: int | None = None, ef: int | None = None, refine_factor: int | None = None, bypass_vector_index: bool = True, fast_search: bool = False,
) -> DataFrame:
    """The k nearest rows with ``_distance`` (float); ties go by ``row_id``.

    ``lower_bound <= _distance < upper_bound`` holds before the k are taken; ``filter``
    too unless ``prefilter`` is false.  The scan is exact: a distance per row and a top-k
    per task, so only k rows of each task move; index tuning arguments are accepted and
    change nothing.
    """
    _check(k, offset)
    if not query_vector:
        raise ValueError("the query vector is empty")
    if distance_type not in METRICS:
        raise ValueError(f"distance_type must be one of {METRICS}")
    for name, value in (("nprobes", nprobes), ("ef", ef), ("refine_factor", refine_factor)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be positive")
    if vector_column not in df.columns:
        raise ValueError(f"unknown column {vector_column}")
    shown = _columns(df, columns, ("_rowid",) if not with_row_id else ())
    if filter and prefilter:
        df = df.filter(filter)
    query = F.array(*[F.lit(float(x)) for x in query_vector])
    out = df.filter(F.size(vector_column) == len(query_vector)).withColumn("__d", distance(F.col(vector_column), query, distance_type))
    if lower_bound is not None:
        out = out.filter(F.col("__d") >= lower_bound)
    if upper_bound is not None:
        out = out.filter(F.col("__d") < upper_bound)
    order = ["__d", row_id] if row_id in df.columns else ["__d"]
    out = out.orderBy(*order).limit(k + offset)
    if offset:
        out = out.offset(offset)
    if filter and not prefilter:
        out = out.filter(filter)
    return out.select(*shown, F.col("__d").cast("float").alias("_distance"))


def parse_options(text: str | None) -> dict:
    """``key=value`` comma list of the match options; unknown or malformed keys are errors."""
    out = {"fuzziness": None, "operator": "OR", "boost": 1.0, "prefix_length": 0, "max_expansions": 50}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        key, eq, value = part.partition("=")
        key, value = key.strip().lower(), value.strip()
        if not eq or key not in out:
            raise ValueError(f"bad option {part!r}")
        if key == "operator":
            if value.upper() not in ("AND", "OR"):
                raise ValueError("operator must be AND or OR")
            out[key] = value.upper()
        elif key == "boost":
            out[key] = float(value)
        else:
            out[key] = int(value)
            if out[key] < (1 if key == "max_expansions" else 0):
                raise ValueError(f"bad {key}")
    return out


def query_tokens(query: str, **analysis) -> list[str]:
    """Distinct tokens of a query text, split as texts are."""
    return list(dict.fromkeys(_query_words(query, **analysis)))


def _query_words(query: str, **analysis) -> list[str]:
    import re

    text = query.lower() if analysis.get("lower_case", True) else query
    if analysis.get("ascii_folding"):
        text = text.translate(str.maketrans(*FOLDED))
    words = re.findall(r"[^\W_]+", text)
    if analysis.get("base_tokenizer") == "ngram":
        words = [w[i : i + 3] for w in words for i in range(len(w) - 2)]
    return [w for w in words if len(w) <= (analysis.get("max_token_length") or 1 << 30)]


def _term_test(words: Column, term: str, options: dict) -> Column:
    if not options["fuzziness"]:
        return F.array_contains(words, term)
    head = term[: options["prefix_length"]]
    near = lambda w: F.levenshtein(w, F.lit(term), options["fuzziness"]).between(0, options["fuzziness"]) & w.startswith(head)
    return F.exists(words, near)


def match(column: str, query: str, options: str | None = None, **analysis) -> Column:
    """Whether a text has any (or, with operator=AND, every) token of the query."""
    opts, terms = parse_options(options), query_tokens(query, **analysis)
    words = tokens(F.col(column), **analysis)
    if not terms:
        return F.lit(False)
    tests = [_term_test(words, t, opts) for t in terms]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if opts["operator"] == "AND" else out | t
    return F.coalesce(out, F.lit(False))


def _followers(words: Column, term: str, starts: Column, slop: int) -> Column:
    """Places of the term that follow one of ``starts`` closely enough."""
    places = F.filter(F.transform(words, lambda w, i: F.when(w == term, i)), lambda p: p.isNotNull())
    return F.filter(places, lambda p: F.exists(starts, lambda s: (p > s) & (p <= s + 1 + slop)))


def _occurrences(words: Column, term: str, options: dict) -> Column:
    if not options["fuzziness"]:
        return F.size(F.filter(words, lambda w: w == term))
    head, most = term[: options["prefix_length"]], options["fuzziness"]
    return F.size(F.filter(words, lambda w: F.levenshtein(w, F.lit(term), most).between(0, most) & w.startswith(head)))


def match_phrase(column: str, query: str, slop: int = 0, **analysis) -> Column:
    """Whether the query's tokens follow each other, with at most ``slop`` extra places before each."""
    if slop < 0:
        raise ValueError("slop must not be negative")
    terms = _query_words(query, **(analysis | {"max_token_length": None}))
    if not terms:
        return F.lit(False)
    words = tokens(F.col(column), **(analysis | {"max_token_length": None}))
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == terms[0], i)), lambda p: p.isNotNull())
    for t in terms[1:]:
        starts = _followers(words, t, starts, slop)
    return F.coalesce(F.size(starts) > 0, F.lit(False))


def multi_match(query: str, columns: list[str], options: str | None = None, **analysis) -> Column:
    """Whether any of two or more columns matches; the operator joins the terms within a column."""
    if len(columns) < 2:
        raise ValueError("multi-match needs at least two columns")
    out = match(columns[0], query, options, **analysis)
    for c in columns[1:]:
        out = out | match(c, query, options, **analysis)
    return out


def bm25(df: DataFrame, columns: list[str], query: str, key: str = "_rowid", options: str | None = None, **analysis) -> DataFrame:
    """``key`` and ``_score`` of the rows that match, summed over columns.

    One pass counts rows, lengths and document frequencies of the query's terms; a second
    scores each row from its own tokens.  Nothing is exploded, nothing is shuffled but
    the few sums.
    """
    opts, terms = parse_options(options), query_tokens(query, **analysis)
    if not terms:
        raise ValueError("the query has no token")
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    total, hit = F.lit(0.0), F.lit(False)
    own = df.select(key, *[tokens(F.col(c), **analysis).alias(f"__w{i}") for i, c in enumerate(columns)])
    sums = []
    for i in range(len(columns)):
        words = F.col(f"__w{i}")
        sums += [F.count(words).alias(f"n{i}"), F.avg(F.size(words)).alias(f"l{i}")]
        sums += [F.count_if(_term_test(words, t, opts)).alias(f"d{i}_{j}") for j, t in enumerate(terms)]
    stats = own.agg(*sums).first()
    for i in range(len(columns)):
        words, n, average = F.col(f"__w{i}"), stats[f"n{i}"], stats[f"l{i}"] or 1.0
        found = [_term_test(words, t, opts) for t in terms]
        here = found[0]
        for f in found[1:]:
            here = here & f if opts["operator"] == "AND" else here | f
        score = F.lit(0.0)
        for j, t in enumerate(terms):
            d = stats[f"d{i}_{j}"]
            idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
            tf = _occurrences(words, t, opts).cast("double")
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(words) / average))
        total = total + F.when(F.coalesce(here, F.lit(False)), score).otherwise(0.0)
        hit = hit | F.coalesce(here, F.lit(False))
    return own.filter(hit).select(key, (total * opts["boost"]).alias("_score"))


def search(df: DataFrame, query: str, k: int = 10, search_columns: list[str] | None = None, columns=None, filter: str | None = None, options: str | None = None, row_id: str = "_rowid", **analysis) -> DataFrame:
    """The k rows of highest BM25 ``_score``; statistics cover the whole table, ``filter`` the results."""
    _check(k, 0)
    if not search_columns:
        raise ValueError("search_columns is required")
    _columns(df, search_columns, ())
    scored = bm25(df, search_columns, query, row_id, options, **analysis)
    shown = _columns(df, columns, ("_rowid",))
    rows = df.filter(filter) if filter else df
    best = rows.join(scored, row_id).orderBy(F.desc("_score"), row_id).limit(k)
    return best.select(*shown, F.col("_score").cast("float"))


def hybrid_search(
    df: DataFrame, query_vector: list[float], query: str, k: int = 10, vector_column: str = "vector", search_columns: list[str] | None = None, candidates: int | None = None,
    rrf_k: int = 60, offset: int = 0, distance_type: str = "l2", columns=None, filter: str | None = None, row_id: str = "_rowid",
) -> DataFrame:
    """Reciprocal rank fusion of the vector and the full-text candidates.

    Relevance is the sum of 1 / (rank + rrf_k) with ranks from 0; ties go to the better
    best rank, then to the smaller row id.
    """
    _check(k, offset)
    n = max(candidates or 0, k + offset)
    rows = df.filter(filter) if filter else df
    near = vector_search(rows, query_vector, n, vector_column, distance_type, [row_id], row_id=row_id, with_row_id=True)
    if not search_columns:
        raise ValueError("search_columns is required")
    texts = bm25(df, search_columns, query, row_id)
    texts = (rows.select(row_id).join(texts, row_id) if filter else texts).orderBy(F.desc("_score"), row_id).limit(n)
    ranked_v = near.withColumn("__rv", F.row_number().over(Window.orderBy("_distance", row_id)) - 1)  # at most n rows
    ranked_t = texts.withColumn("__rt", F.row_number().over(Window.orderBy(F.desc("_score"), row_id)) - 1)
    last = 2**31 - 1
    both = ranked_v.join(ranked_t, row_id, "full")
    part = lambda c: F.coalesce(1.0 / (F.col(c) + rrf_k), F.lit(0.0))
    both = both.withColumn("_relevance_score", part("__rv") + part("__rt"))
    both = both.withColumn("__best", F.least(F.coalesce("__rv", F.lit(last)), F.coalesce("__rt", F.lit(last))))
    top = both.orderBy(F.desc("_relevance_score"), "__best", row_id).limit(k + offset)
    top = top.offset(offset) if offset else top
    shown = _columns(df, columns, ("_rowid",))
    return df.join(F.broadcast(top), row_id).select(*shown, "_distance", F.col("_score").cast("float"), "_relevance_score")
