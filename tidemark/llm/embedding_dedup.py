"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector the signs of its projections on random directions, seen from
the mean of its label, sorts the vectors of a label by these bits and compares each with
its next neighbours.  Pairs at or above the cosine link; a partition passes on only a
spanning forest of its links, and the rows at its ends, which are compared across the
ends of partitions.  The forests of all passes make the components.  Inside a component
all pairs are then counted exactly, block against block, so the number of direct links
depends neither on the window nor on the number of passes.

Labels of at most ``EXACT`` rows are compared whole, in one pass.  For the others the
number of passes and the window follow from all rows of the label: the keys of the first
passes, sorted, tell of every vector how many leading bits another must share with it
until at most a window of rows shares them, and a pair at the threshold agrees in a bit
with probability 1 - angle / pi, its angle seen from the mean.  Directions need not
spread evenly: the more rows share their leading bits, the more passes or the wider
windows, up to the whole label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import SHORT_ROWS, forget, materialize
from tidemark.llm.components import connected_components

BITS = 48
WINDOW = 32
BLOCK_ROWS = 512
MISS = 1e-3
EXACT = 1024
TRIALS = 12
#: Directions in which vectors at the threshold are supposed to lie, dealt by id.
TURNS = 64
#: Units of a component of the mean, whose sums are whole numbers and so don't depend on the order.
UNITS = 1 << 30
#: Probabilities of meeting are counted by their logarithm, this many steps to a factor of two, rounded down.
STEPS, LEAST = 16, 20
#: What sending a row through a pass costs, in comparisons.
SEND = 512
#: Plans of so many labels are broadcast at most.
PLANS = 10_000


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (double) of an array column of one dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(column), -1)
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)  # squares of large or tiny components stay finite
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows that can link, with their dimension; vectors with null, non-finite or only zero components stay out."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull())
    return out.filter((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def enough_passes(met: np.ndarray, rows: np.ndarray, miss: float = MISS) -> int | None:
    """Passes after which pairs of ``rows`` that meet in a pass with probabilities ``met`` were never compared with probability ``miss``."""
    left = lambda passes: np.average((1 - met) ** passes, weights=rows)
    low, high = 0, 1
    while left(high) > miss:
        low, high = high, high * 2
        if high > 1 << 20:
            return None
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if left(middle) <= miss else (middle, high)
    return high


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of a batch by label and dimension."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            names = part.column("label").dictionary_encode()
            at = names.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            held, first = np.unique(at[order], return_index=True)
            units = np.rint(unit_rows(part.column("embedding"))[order] * UNITS).astype(np.int64)
            sums = np.add.reduceat(units, first, axis=0)
            counts = np.diff([*first, len(at)])
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(held)), pa.array(np.full(len(held), dim), pa.int32()), pa.array(counts, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                names=["label", "dim", "vectors", "sums"],
            )


def _centres(distinct: DataFrame) -> DataFrame:
    """The mean of the different vectors of each label and dimension."""
    parts = distinct.select("label", "dim", "embedding").mapInArrow(_sums, "label string, dim int, vectors long, sums array<long>")
    places = parts.select("label", "dim", "vectors", F.posexplode("sums").alias("place", "units"))
    means = places.groupBy("label", "dim", "place").agg((F.sum("units") / F.sum("vectors") / UNITS).alias("mean"))
    listed = means.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("place", "mean"))).alias("listed"))
    return listed.select("label", "dim", F.transform("listed", lambda x: x["mean"]).alias("centre"))


SURVEY = "label string, dim int, pass int, key long, vec_id long, copies long, rows int, agree double"


def _survey(cosine: float, seed: int) -> Callable:
    """Keys of the first passes, and how likely a vector and another at the threshold agree in a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit, centre = unit_rows(part.column("embedding")), part.column("centre").flatten().to_numpy().reshape(-1, dim)
                turn = np.random.default_rng([seed, int(dim)]).normal(size=(TURNS, dim))[part.column("vec_id").to_numpy() % TURNS]
                turn -= np.sum(turn * unit, 1, keepdims=True) * unit
                turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
                one, other = unit - centre, cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * turn - centre
                norms = np.linalg.norm(one, axis=1) * np.linalg.norm(other, axis=1)
                seen = np.where(norms > 1e-9, np.sum(one * other, 1) / np.maximum(norms, 1e-9), 0.0)
                agree = 1 - np.arccos(np.clip(seen, -1, 1)) / math.pi
                for p in range(TRIALS):
                    keys = _keys_of(one, _planes(seed, int(dim), p))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label"), part.column("dim"), pa.array(np.full(len(part), p), pa.int32()), pa.array(keys), *(part.column(c) for c in ("vec_id", "copies", "rows")), pa.array(agree)],
                        names=["label", "dim", "pass", "key", "vec_id", "copies", "rows", "agree"],
                    )

    return run


def met_in(keys: np.ndarray, copies: np.ndarray, agree: np.ndarray, windows: list[int], before: bool = False, behind: bool = False) -> np.ndarray:
    """Probabilities (a row for each window) that a pass compares vectors with another at the threshold.

    ``keys`` are sorted.  With ``before`` or ``behind`` the run goes on there, in another
    partition: rows that share bits with that end then count as too many for any window.
    """
    met, open_ = np.zeros((len(windows), len(keys))), np.ones((len(windows), len(keys)), bool)
    for level in range(BITS + 1):
        part = keys >> (BITS - level)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.add.reduceat(copies, first).astype(np.float64)
        sizes[0] = math.inf if before else sizes[0]
        sizes[-1] = math.inf if behind else sizes[-1]
        others = np.repeat(sizes, np.diff([*first, len(keys)])) - copies
        for i, w in enumerate(windows):
            fits = open_[i] & (others <= w)
            met[i, fits] = agree[fits] ** level
            open_[i] &= ~fits
        if not open_.any():
            break
    return met


def _met(windows: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(held)
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (table.column(c).to_numpy() for c in ("label", "dim", "pass"))], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(table)], strict=True):
            run = table.slice(a, b - a)
            keys, copies, agree = (run.column(c).to_numpy() for c in ("key", "copies", "agree"))
            cut = copies.sum() < run.column("rows")[0].as_py()
            met = met_in(keys, copies, agree, windows, cut and a == 0, cut and b == len(table))
            out = run.select(["label", "dim", "vec_id", "copies"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(m) for m in met)], names=[*out.schema.names, *(f"met{i}" for i in range(len(met)))])

    return run


def plan_for(met: list[np.ndarray], counts: list[np.ndarray], rows: int, window: int = WINDOW) -> tuple[int, int]:
    """Passes and window for a label of ``rows`` vectors: ``counts`` of them meet another in a pass with probability ``met``, for windows from ``window`` on, doubled each time."""
    plans = [(2 * rows + SEND, 1, rows)]  # all pairs of the label, which one task compares
    for i, (m, c) in enumerate(zip(met, counts, strict=True)):
        if (i == 0 or window << i < rows) and (n := enough_passes(m, c)) is not None:
            plans.append((n * ((window << i) + SEND), n, window << i))
    return min(plans)[1:]


PLAN = "label string, dim int, passes int, window int"


def _plan(window: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        place, step, count = (table.column(c).to_numpy() for c in ("place", "step", "count"))
        met = np.where(step < STEPS * LEAST, 2.0 ** (-step / STEPS), 0.0)
        each = [place == i for i in range(place.max() + 1)]
        told = plan_for([met[e] for e in each], [count[e] for e in each], int(count[each[0]].sum()), window)
        return pa.Table.from_pylist([{"label": key[0].as_py(), "dim": key[1].as_py(), "passes": told[0], "window": told[1]}], PLAN_SCHEMA)

    return run


PLAN_SCHEMA = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("passes", pa.int32()), ("window", pa.int32())])


def _plans(told: DataFrame, largest: int, cosine: float, window: int, seed: int) -> DataFrame:
    """Passes and window of each label and dimension from all its vectors; only counts by probability meet in one task."""
    windows = [window]
    while windows[-1] * 2 < largest:
        windows.append(windows[-1] * 2)
    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "dim", "key", "vec_id"]
    dealt = told.mapInArrow(_survey(cosine, seed), SURVEY).repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [f"met{i}" for i in range(len(windows))]
    met = dealt.mapInArrow(_met(windows), "label string, dim int, vec_id long, copies long, " + ", ".join(f"{m} double" for m in names))
    met = met.groupBy("label", "dim", "vec_id").agg((F.sum("copies") / TRIALS).cast("long").alias("copies"), *(F.avg(m).alias(m) for m in names))
    each = met.select("label", "dim", "copies", F.posexplode(F.array(*names)).alias("place", "met"))
    last = F.lit(STEPS * LEAST)
    step = F.when(F.col("met") > 0, F.least(last, F.ceil(-F.log2("met") * STEPS))).otherwise(last).cast("int")
    counts = each.groupBy("label", "dim", "place", step.alias("step")).agg(F.sum("copies").alias("count"))
    return counts.groupBy("label", "dim").applyInArrow(_plan(window), PLAN)


def _planned(valid: DataFrame, cosine: float, window: int, seed: int, passes: int | None) -> DataFrame:
    """``valid`` with the ``passes``, ``window`` and ``centre`` of each row's label and dimension."""
    spread = lambda small: F.broadcast(small) if small.count() <= PLANS else small
    sizes = materialize(valid.groupBy("label", "dim").agg(F.count("*").cast("int").alias("rows")), "sizes")
    large = sizes if passes else sizes.filter(F.col("rows") > EXACT)
    largest = large.agg(F.max("rows")).first()[0]
    if largest is None:  # small labels are compared whole
        plans = sizes.select("label", "dim", F.lit(1).alias("passes"), F.col("rows").alias("window"), F.lit(None).cast("array<double>").alias("centre"))
        return valid.join(spread(plans), ["label", "dim"])
    among = valid.join(spread(large), ["label", "dim"]).groupBy("label", "dim", "rows", "embedding")
    distinct = materialize(among.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "distinct", SHORT_ROWS)
    centres = materialize(_centres(distinct), "centres", SHORT_ROWS)
    if passes:
        found = centres.withColumns({"passes": F.lit(passes), "window": F.lit(window)})
    else:
        plans = materialize(_plans(distinct.join(spread(centres), ["label", "dim"]), largest, cosine, window, seed), "plans", SHORT_ROWS)
        found = centres.join(plans, ["label", "dim"])
    forget(distinct)
    plans = sizes.join(found, ["label", "dim"], "left").select("label", "dim", F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce("window", "rows").alias("window"), "centre")
    return valid.join(spread(materialize(plans, "plans")), ["label", "dim"])


def _planes(seed: int, dim: int, number: int) -> np.ndarray:
    """The directions of a pass."""
    return np.random.default_rng([seed, dim, number]).normal(size=(dim, BITS))


def _keys_of(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return (vectors @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _sign(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = unit_rows(part.column("embedding"))
                told = part.column("centre").is_valid().to_numpy(zero_copy_only=False)
                unit[told] -= part.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                passes = part.column("passes").to_numpy()
                for p in range(passes.max()):
                    rows = np.flatnonzero(passes > p)
                    keys = _keys_of(unit[rows], _planes(seed, int(dim), p))
                    of = part.take(pa.array(rows)) if len(rows) < len(part) else part
                    yield pa.RecordBatch.from_arrays(
                        [of.column("label"), of.column("dim"), pa.array(np.full(len(rows), p), pa.int32()), pa.array(keys), of.column("vec_id"), of.column("window"), of.column("embedding")],
                        names=[*ORDER, "window", "embedding"],
                    )

    return run


ORDER = ["label", "dim", "pass", "key", "vec_id"]
COLUMN_BLOCK = 4096


def _roots(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _linked(unit: np.ndarray, known: int, window: int, cosine: float) -> np.ndarray:
    """The component's first row for each row, where rows from ``known`` on are compared with the ``window`` rows before them."""
    parent = np.arange(len(unit))
    for i in range(known, len(unit), BLOCK_ROWS):
        j = min(len(unit), i + BLOCK_ROWS)
        for c in range(max(0, i - window), j, COLUMN_BLOCK):
            d = min(j, c + COLUMN_BLOCK)
            near = unit[i:j] @ unit[c:d].T >= cosine
            while True:
                near &= parent[i:j, None] != parent[None, c:d]
                rows = np.flatnonzero(near.any(1))
                if not len(rows):
                    break
                for x, y in zip((i + rows).tolist(), (c + near[rows].argmax(1)).tolist(), strict=True):
                    while parent[x] != x:
                        x = parent[x]
                    while parent[y] != y:
                        y = parent[y]
                    parent[max(x, y)] = min(x, y)
                parent = _roots(parent)
    return parent


def _windows(cosine: float, ends: bool) -> Callable:
    """Links between neighbours of a partition's runs (one label, dimension and pass), as a spanning forest.

    With ``ends`` also the rows of a partition's first and last run that may have
    neighbours in the partition before or behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, schema = None, None
        head, first, going = 0, 0, True  # rows given out from the start; rows of the first run; whether it goes on

        def out(pairs: tuple, rows: pa.Table | None) -> pa.RecordBatch:
            a, b = (pa.array(x, pa.int64()) for x in pairs)
            if not ends:
                return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
            n, m = len(a), len(rows) if rows is not None else 0
            columns = [pa.concat_arrays([a, pa.nulls(m, pa.int64())]), pa.concat_arrays([b, pa.nulls(m, pa.int64())])]
            for f in schema:
                given = rows.column(f.name).combine_chunks() if m else pa.nulls(0, f.type)
                columns.append(pa.concat_arrays([pa.nulls(n, f.type), *(given.chunks if isinstance(given, pa.ChunkedArray) else [given])]))
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", *schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema, known = batch.schema, 0 if tail is None else len(tail)
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            names = [table.column(c).to_numpy() for c in ("label", "dim", "pass")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            ids, windows, members, roots, rim = table.column("vec_id").to_numpy(), table.column("window").to_numpy(), [], [], None
            for a, b in zip([0, *cuts], [*cuts, len(table)], strict=True):
                if b <= known:
                    continue
                parent = _linked(unit_rows(table.column("embedding").slice(a, b - a)), max(0, known - a), int(windows[a]), cosine)
                held = np.flatnonzero(parent != np.arange(len(parent)))
                members.append(ids[a + held])
                roots.append(ids[a + parent[held]])
            if going:
                stop = int(cuts[0]) if len(cuts) else len(table)
                if stop > known:
                    rim = table.slice(known, max(0, min(stop - known, int(windows[0]) - head)))
                    head, first = head + len(rim), first + stop - known
                going = not len(cuts)
            yield out((np.concatenate(members), np.concatenate(roots)), rim)
            start = int(cuts[-1]) if len(cuts) else 0
            tail = table.slice(max(start, len(table) - int(windows[-1])))  # the next batch goes on from here
        if ends and tail is not None:
            yield out(([], []), tail.slice(max(0, head - (first - len(tail)))) if going else tail)

    return run


COUNT = T.StructType().add("vec_id", "long").add("links", "long")


def _merged(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one id as one: linked with what any of them is linked with."""
    if (ids[1:] > ids[:-1]).all():
        return ids, near
    order = np.argsort(ids, kind="stable")
    distinct, first = np.unique(ids[order], return_index=True)
    return distinct, np.logical_or.reduceat(near[order], first, axis=0) if len(distinct) < len(ids) else near[order]


def _count(cosine: float) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        one, other = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        same = key[-2].as_py() == key[-1].as_py()
        other = one if same else other
        if not len(one) or not len(other):
            return COUNT_SCHEMA.empty_table()
        ids, ids2 = one.column("vec_id").to_numpy(), other.column("vec_id").to_numpy()
        near = unit_rows(one.column("embedding")) @ unit_rows(other.column("embedding")).T >= cosine
        near &= ids[:, None] != ids2[None, :]
        ids, near = _merged(ids, near)  # rows that share an id stand for one vector
        ids2, near = _merged(ids2, near.T)
        near = near.T
        rows, sums = (ids, near.sum(1)) if same else (np.concatenate([ids, ids2]), np.concatenate([near.sum(1), near.sum(0)]))
        return pa.table({"vec_id": pa.array(rows, pa.int64()), "links": pa.array(sums, pa.int64())})

    return run


COUNT_SCHEMA = pa.schema([("vec_id", pa.int64()), ("links", pa.int64())])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, window: int = WINDOW, passes: int | None = None, seed: int = 17) -> DataFrame:
    """Per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``n_links``, ``component_id`` and ``kept``.

    Rows are compared only when their labels (not null) and dimensions are equal, by
    cosine in double precision.  Null, empty or zero vectors, vectors with null or
    non-finite components, null labels and null ids link with nothing (a null id has a
    null component and is not kept).  Rows that share an id stand for one vector: they
    do not link with each other and get one result.  Other columns are ignored; an empty
    table gives an empty table.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string"))
    valid = _valid(vectors)
    spark = valid.sparkSession
    schema = T.StructType().add("label", "string").add("dim", "integer").add("pass", "integer").add("key", "long").add("vec_id", "long").add("window", "integer").add(valid.schema["embedding"])
    signed = _planned(valid, cosine, window, seed, passes).select(*valid.columns, "passes", "window", "centre").mapInArrow(_sign(seed), schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "dim", "key", "vec_id"]
    dealt = signed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *(T.StructField(f.name, f.dataType) for f in schema)])
    compared = materialize(dealt.mapInArrow(_windows(cosine, True), found), "windows", 1000)
    ends = compared.filter("a is null").drop("a", "b").repartition(n, "pass", "label", "dim").sortWithinPartitions(*order)
    across = ends.mapInArrow(_windows(cosine, False), "a long, b long")
    edges = compared.filter("a is not null").select("a", "b").union(across).distinct()
    groups = materialize(connected_components(edges, "vectors"), "vectors")

    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    members = valid.join(groups, valid.vec_id == groups.node).join(sizes, "component").drop("node")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    paired = members.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", "label", "dim", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "vec_id", "embedding")
    counts = paired.groupBy("component", "label", "dim", "i", "j").applyInArrow(_count(cosine), COUNT).groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = groups.join(counts, groups.node == counts.vec_id, "left").select(F.col("node"), "component", "links")
    out = vectors.select("vec_id").join(found, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
