import glob
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import awkward, documents, prose
from tidemark.llm import _shared, decontaminate, embedding_dedup, html_extract, language, license_scan, mixing, quality, queries, shingle_join, token_counts, token_output
from tidemark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


class Groups:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


# -- shared ------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    texts = pa.array(["ab c", "", "c ab c ", "x" * 500, "ab"])
    raw, bounds = _shared.raw_text(texts)
    words, firsts = _shared.word_hashes(raw, bounds, shingle_join.BETWEEN)
    assert firsts.tolist() == [0, 2, 2, 5, 6, 7]
    assert words[0] == words[3] == words[6] and words[1] == words[2] == words[4] and len(set(words.tolist())) == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_key_table(keys, others):
    table = _shared.KeyTable(np.array(keys[: len(keys) // 2], np.uint64))
    table.add(np.array(keys[len(keys) // 2 :], np.uint64))
    want = {k: i for i, k in enumerate(keys)}
    probe = keys + others
    assert table.find(np.array(probe, np.uint64)).tolist() == [want.get(k, -1) for k in probe]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    g = Groups({x for e in edges for x in e})
    for a, b in edges:
        g.join(a, b)
    found = connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long"))
    want = {x: g.root(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}
    assert dict(rows(found, "node", "component")) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 -----------------------------------------------------------------------------


def test_embedding_dedup(spark):
    rng, data = np.random.default_rng(1), []
    for i in range(300):
        v = rng.normal(size=16)
        data.append((i, v.tolist(), i % 3))
        if i % 5 == 0:
            data += [(1000 + 10 * i + j, (v + rng.normal(size=16) * 0.05).tolist(), i % 3) for j in range(3)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0] * 16, None), (5004, [1.0] * 16, None), (5005, [], 1), (5006, [1.0, None], 1), (None, [1.0] * 16, 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<double>, label int, component string")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    g, links = Groups([i for i, *_ in data]), dict.fromkeys([i for i, *_ in data], 0)
    for a, u, k in data:
        for b, v, m in data:
            if a < b and k == m and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[a] += 1
                links[b] += 1
                g.join(a, b)
    assert {i: (found[i].n_links, found[i].component_id) for i in links} == {i: (links[i], g.root(i)) for i in links}
    for i in range(5000, 5007):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[5008].component_id == 5007 and found[5008].n_links == 1 and not found[5008].kept
    assert found[None].component_id is None and not found[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_a_label_in_one_direction(spark):
    """Planted pairs at the threshold are found although all vectors of the label lean one way (mean cosine 0.8)."""
    rng, n = np.random.default_rng(5), 12_000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    lean = unit(rng.normal(size=32))
    vectors = unit(math.sqrt(0.8) * lean + math.sqrt(0.2) * unit(rng.normal(size=(n, 32))))
    turn = rng.normal(size=(400, 32))
    turn = unit(turn - np.sum(turn * vectors[:400], 1, keepdims=True) * vectors[:400])
    vectors = np.concatenate([vectors, 0.935 * vectors[:400] + math.sqrt(1 - 0.935**2) * turn])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(found[i] != found[n + i] for i in range(400)) <= 2


def test_embedding_dedup_plans_by_all_rows(spark):
    """Pairs are found in a tight part of a label, whichever ids its rows have: here those that a sample by hash left out."""
    rng, n, dim = np.random.default_rng(6), 16_000, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    ids = spark.range(60_000).withColumn("sampled", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(n)) < 8192).collect()
    picked = [r.id for r in ids if r.sampled][: n // 4] + [r.id for r in ids if not r.sampled][: n - n // 4]
    vectors = unit(rng.normal(size=(n, dim)))
    tight = np.arange(n // 4, n)
    lean = unit(rng.normal(size=dim))
    vectors[tight] = math.sqrt(0.8) * lean + math.sqrt(0.2) * unit(vectors[tight] - np.outer(vectors[tight] @ lean, lean))
    ones, others = tight[:1000], tight[-1000:]
    turn = rng.normal(size=(1000, dim))
    turn = unit(turn - np.sum(turn * vectors[ones], 1, keepdims=True) * vectors[ones])
    vectors[others] = 0.931 * vectors[ones] + math.sqrt(1 - 0.931**2) * turn
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(picked, vectors, strict=True)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(found[picked[a]] != found[picked[b]] for a, b in zip(ones, others, strict=True)) <= 4


def test_embedding_dedup_counts_neighbours_of_all_rows():
    """A row's chance to meet another follows from the bits that no more than a window of other rows shares, copies apart."""
    keys = np.sort(np.array([0b00, 0b01, 0b10, 0b10, 0b11]) << (embedding_dedup.BITS - 2))
    copies, agree = np.array([1, 1, 1, 1, 5]), np.full(5, 0.5)
    assert embedding_dedup.met_in(keys, copies, agree, [1, 2, 8]).tolist() == [[0.5, 0.5, 0.25, 0.25, 0.25], [0.5, 0.5, 0.25, 0.25, 0.5], [1, 1, 1, 1, 1]]
    assert embedding_dedup.met_in(keys, copies, agree, [8], before=True).tolist() == [[0, 0.25, 0.5, 0.5, 0.5]]


def test_embedding_dedup_across_partitions(spark):
    """Neighbours stay neighbours where a run of sorted rows is cut, into however small partitions."""
    vectors = [[1.0, 0.0] if i % 7 == 0 else [math.cos(i), math.sin(i)] for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"label": ["0"] * 40, "dim": [2] * 40, "pass": [0] * 40, "key": list(range(40)), "vec_id": list(range(40)), "window": [7] * 40, "embedding": vectors})
    for size in (1, 3, 9, 25):
        cut, ends = Groups(range(40)), []
        for at in range(0, 40, size):
            for b in embedding_dedup._windows(0.99, True)(batch.slice(k, min(2, at + size - k, 40 - k)) for k in range(at, min(at + size, 40), 2)):
                ends.append(b.filter(b["a"].is_null()).drop_columns(["a", "b"]))
                links = b.filter(b["a"].is_valid())
                for x, y in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
                    cut.join(x, y)
        ends = pa.Table.from_batches(ends).sort_by("key").combine_chunks().to_batches()
        for b in embedding_dedup._windows(0.99, False)(iter(ends)):
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
                cut.join(x, y)
        assert {cut.root(i) for i in range(0, 40, 7)} == {0}


# -- 2 -----------------------------------------------------------------------------


def test_mixing_reaches_targets(spark):
    r = random.Random(2)
    data = [(i, prose(i, r.randrange(1, 60)), "en", r.choice(["a", "b", "c", "d", None]) if i > 20 else "e", 0, *"xxxxxx") for i in range(400)]
    out = mixing.curriculum(documents(spark, data)).select("doc_id", "source", "size", "source_size", "target", "taken", "position").collect()
    sizes, targets, taken = {}, {}, {}
    for x in out:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        targets[x.source] = x.target
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert 0 <= x.taken <= 3 * x.size and (x.position is None) == (x.taken == 0)
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9, strict=False))
    want, free = {}, dict(weights)
    while True:  # reshare what is above the cap until nothing is
        left = sum(sizes.values()) - sum(want.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            del free[s]
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert all(targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixing_awkward(spark):
    docs = documents(spark)
    out = mixing.curriculum(docs)
    assert out.count() == len(awkward()) and rows(out, "doc_id", "taken") == rows(mixing.curriculum(docs), "doc_id", "taken")
    assert mixing.curriculum(docs.limit(0)).count() == 0
    assert {r.taken for r in out.filter("size = 0").collect()} == {0}
    ordered = mixing.training_order(docs)
    assert ordered.agg(F.sum("words")).first()[0] == out.agg(F.sum("taken")).first()[0]
    assert [r.position for r in ordered.collect()] == sorted(r.position for r in ordered.collect())
    assert all(len(WORD.findall(r.text)) == r.words for r in ordered.collect())


def test_mix_query_writes_the_training_order(spark, monkeypatch):
    """The query's mix is written by ranges of positions, sorted, every round of every document; its digest comes from there."""
    written, write = [], _shared.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name, *a: written.append(write(df, name, *a)) or written[-1], raising=False)
    got = queries.op2_mix_sources(spark, SF)
    assert written
    parts = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{written[-1]._written.removeprefix('file:')}/*.parquet"))]
    order = [r for part in parts for r in part if r["epoch"] is not None]
    assert len(parts) > 1 and [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert all(len(WORD.findall(r["text"])) == r["words"] for r in order)
    texts = {r.doc_id: len(WORD.findall(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, first = dict.fromkeys(texts, 0), dict.fromkeys(texts)
    for r in order:
        taken[r["doc_id"]] += r["words"]
        first[r["doc_id"]] = r["position"] if first[r["doc_id"]] is None else first[r["doc_id"]]
    assert max(r["epoch"] for r in order) > 0 and any(t == 0 for t in taken.values())
    assert {r.doc_id: (r.size, r.taken, r.position) for r in got.collect()} == {i: (texts[i], taken[i], first[i]) for i in texts}


def test_mix_digest_of_a_written_order_awkward(spark):
    docs, columns = documents(spark), ("doc_id", "size", "source_size", "target", "taken", "position")
    assert rows(mixing.read_digest(mixing.write_order(docs)), *columns) == rows(mixing.curriculum(docs), *columns)
    assert mixing.read_digest(mixing.write_order(docs.limit(0))).count() == 0


def test_position_inverts_demand(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("u"))
    for a in (-0.5, 0.0, 0.5):
        for u, t in df.select("u", mixing.position_of(F.col("u"), F.lit(1.0), F.lit(a))).collect():
            assert t + a * (t * t - t) == pytest.approx(u)


# -- 3 -----------------------------------------------------------------------------


def shingles(text, k=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def jaccard(data, percent=80):
    sets = {i: shingles(t) for i, t in data}
    g = Groups(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    g.join(a, b)
    return {i: (len(s), g.root(i)) for i, s in sets.items()}


def variants(seed):
    """Near copies with words changed, cut or added; a line that most documents share; tiny documents."""
    r, data = random.Random(seed), []
    line = "this line stands in very many documents here"
    for i in range(90):
        words = prose(i // 6 + seed, r.choice([3, 5, 6, 7, 9, 10, 12, 15, 20, 60, 150])).split() if i % 6 == 0 else list(base)  # noqa: F821
        if i % 6 == 0:
            base = list(words)
        else:
            for _ in range(r.randrange(3)):
                p = r.randrange(len(words))
                words[p : p + 1] = r.choice([[], [words[p], "new"], [f"w{i}"]])
        data.append((i, " ".join(words) + (f"\n{line}" if i % 4 else "")))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, monkeypatch, seed):
    if seed == 2:  # all lists long, dealt to many parts
        monkeypatch.setattr(shingle_join, "SKETCH_LEAST", 1)
    data = variants(seed)
    found = shingle_join.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard(data)


def test_jaccard_tiles(spark, monkeypatch):
    """Lists of many components just below and above the similarity, cut into tiles of a few rows."""
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", 5)
    monkeypatch.setattr(shingle_join, "SKETCH_LEAST", 1)
    r, data = random.Random(8), []
    for family, (size, members, changes) in enumerate([(120, 60, 2), (300, 40, 4), (60, 40, 1), (2500, 12, 28)]):
        base = [f"{w}{i % 97}" for i, w in enumerate(prose(family, size).split())]
        for i in range(members):
            words = list(base)
            for p in r.sample(range(size), max(1, changes + r.choice([-1, 0, 1, 1]) * (1 + changes // 9))):
                words[p] = f"x{r.randrange(10**6)}"
            data.append((1000 * family + i, " ".join(words)))
    want = jaccard(data)
    assert 20 < len({c for _, c in want.values()}) < 140
    found = shingle_join.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == want


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, n, np.uint64)) for n in (1, 50, 300, 200, 7)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    found = shingle_join._shared_counts(sets)
    assert all(found[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_jaccard_awkward(spark):
    found = shingle_join.jaccard_groups(documents(spark))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.filter("doc_id is not null").collect()}
    assert got == jaccard([(i, t) for i, t, *_ in awkward() if i is not None])
    assert found.count() == len(awkward())
    assert shingle_join.jaccard_groups(documents(spark, [])).count() == 0
    kept = shingle_join.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c} | {None}


def test_jaccard_rows_that_share_an_id(spark):
    """A copy's id may have another text: that text keeps its links, and the id joins both."""
    one, two, three, four = (prose(60 + i, 60) for i in range(4))
    data = [(1, one), (2, one), (2, two), (3, two + " extra"), (10, three), (11, four), (12, three), (12, four), (20, "a b"), (21, "a b"), (21, " "), (30, prose(70, 60))]
    found = rows(shingle_join.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "component_id")
    assert found == sorted([(i, 1 if i < 4 else 10 if i < 20 else 20 if i < 30 else 30) for i, _ in data], key=repr)


def test_light_boundary_covers_all_pairs():
    for percent in (60, 80, 95):
        for n in range(1, 13):
            for m in shingle_join.partners(n, percent):
                assert n in shingle_join.partners(m, percent)
                c = shingle_join.fewest(n, m, percent)
                assert 100 * c >= percent * (n + m - c) and (c == 0 or 100 * (c - 1) < percent * (n + m - c + 1))
    assert shingle_join.boundary({}, 80) == 0 and shingle_join.boundary({5: 100, 6: 100}, 80) >= 5


# -- 4 -----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_pack_round_trip(values):
    control, data = token_output.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4) and token_output.unpack(control, data, len(values)).tolist() == values


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = [(20, "<|startoftext|>x <|ENDOFTEXT|> a~b ~ it's I'M x,y...z", "en", "s", 1, *"xxxxxx")]
    docs = documents(spark, awkward() + special)
    for size in (50, 4_000_000):
        found = token_output.read_digest(token_output.write_tokens(docs, path, 2, file_ids=size)).orderBy("start").collect()
        data = sorted(((i, t or "") for i, t, *_ in awkward() + special), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in found] == [i for i, _ in data]
        want = {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in data for ids in [[*tok.encode(t, add_special_tokens=False).ids, 2]]}
        assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in found} == want
        assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])])[:-1].tolist()
    assert token_output.read_digest(token_output.write_tokens(documents(spark, []), path)).count() == 0


def test_damaged_file_is_refused():
    raw = bytearray(token_output.encode_file([1], np.array([3]), np.array([7, 7, 9], np.uint32)))
    assert token_output.decode_file(bytes(raw))[2].tolist() == [7, 7, 9]
    raw[-1] ^= 1
    with pytest.raises(ValueError):
        token_output.decode_file(bytes(raw))


# -- 5 -----------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op5_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in out if r.held_out]
    assert len(own) > 20 and sum(r.lang == r.lang_pred for r in own) >= 0.95 * len(own)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)


def test_language_awkward(spark):
    model = language.train_language(spark.read.parquet(f"{SF}/documents.parquet"))
    out = {(r.doc_id, r.lang_pred == "und") for r in language.identify_languages(documents(spark), model).collect()}
    assert {i for i, u in out if u} == {1, 2, 3, None} and (None, False) in out
    assert {r.lang_pred for r in language.identify_languages(documents(spark), None).collect()} == {"und"}
    assert language.train_language(documents(spark, [])) is None


# -- 6 -----------------------------------------------------------------------------


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order 4, by the book."""
    lead = chr(quality.START) * 3
    counts = {4: {}}
    for t in texts:
        for i in range(len(t)):
            g = (lead + t)[i : i + 4]
            counts[4][g] = counts[4].get(g, 0) + 1
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discount(k, n):
        have = {i: sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)}
        i = min(n, 3)
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + 2 * have[2] else None
        d = i - (i + 1) * y * have[i + 1] / have[i] if y is not None and have[i] else i - 0.5
        return max(0.05, min(i - 0.05, d))

    def p(g, k=4):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        g = g[-k:]
        same = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not same:
            return p(g, k - 1)
        total, n = sum(same.values()), counts[k].get(g, 0)
        own = (n - discount(k, n)) / total if n else 0
        return own + sum(discount(k, v) for v in same.values()) / total * p(g, k - 1)

    return lambda t: math.exp(-sum(math.log(p((lead + t)[i : i + 4])) for i in range(len(t))) / len(t))


def test_perplexity_is_kneser_ney(spark):
    data = [(i, prose(i, 9), "en", "s", 0, *"xxxxxx") for i in range(12)] + [(50, "zzz Q", "en", "s", 0, *"xxxxxx"), (51, "é😀", "en", "s", 0, *"xxxxxx"), (52, "other", "fr", "s", 0, *"xxxxxx"), (53, None, "en", "s", 0, *"xxxxxx")]
    trusted = spark.createDataFrame([(i,) for i in range(8)] + [(None,)], "doc_id long")
    found = {r.doc_id: r for r in quality.perplexities(documents(spark, data), trusted).collect()}
    model = kneser_ney([t for i, t, *_ in data if found[i].trained])
    assert 0 < sum(r.trained for r in found.values()) < 8
    for i, t, lang, *_ in data:
        if lang == "en" and t and "😀" not in t:
            assert found[i].perplexity == pytest.approx(model(t), rel=1e-6)
    assert found[52].perplexity is None and found[53].perplexity is None and found[51].perplexity > 5


def test_quality_awkward(spark):
    trusted = spark.createDataFrame([(4,), (9,), (14,)], "doc_id long")
    assert quality.judge(documents(spark), trusted).count() == len(awkward())
    assert quality.judge(documents(spark, []), trusted).count() == 0
    kept = quality.filter_quality(documents(spark), trusted.limit(0))
    assert kept.count() == len(awkward()) and kept.columns == documents(spark).columns


def test_quality_parts_junk_from_prose(spark):
    out = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n = {tuple(r)[:2]: r[2] for r in out.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in n and n[0, False] >= 0.6 * (n[0, False] + n.get((0, True), 0))


# -- 7 -----------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h2>My Site</h2></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<div class=ad>Buy this now.</div><article><h1>A title &amp; more</h1><p>First  paragraph of the
 text, it has words.<p><b>Second</b> paragraph &lt;here&gt; with enough words to read.<br>Same block.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside><form><label>Mail</label><input></form>
<section class="comments"><h3>Comments</h3><div class="comment"><b>Joe</b><p>I do not agree with this.</p></div></section><footer>&copy; 2024 My Site</footer></body></html>"""


def test_html_broken_tags():
    """Unclosed quotes leave no markup in the text; elements that are not closed take no article with them."""
    text = lambda html: [x for _, x, _ in html_extract.blocks(html)]
    assert text('<p class="x>Hello</p><p class="y">there</p>') == ["Hello", "there"]
    assert text("<p class='x>Hello") == ["Hello"]
    assert text('<a title="a > b">one</a> <i data-x="<b>bold</b>">two</i>') == ["one two"]
    assert text("<p>one<svg><p>two</p>") == ["one", "two"] and text("<div><iframe></div><p>two</p>") == ["two"]
    assert text("<script src=/js/>var x=1;</script><p>text</p>") == ["text"]
    assert text("<p>a<svg/>b</p>") == ["ab"] and text("<p>one<!-- two") == ["one"] and text("<p>one <! two") == ["one"]
    assert text("<p>1 < 2 and a<b</p>")[0].startswith("1 < 2 and a")
    for name in ("svg", "math", "object", "canvas", "audio", "video", "iframe", "noscript"):
        assert text(f"<div><p>before</p><{name}></div><p>the article</p>") == ["before", "the article"]


def test_html_long_page_is_labelled_like_a_short_one():
    model = html_extract.trained()
    page = html_extract.blocks(PAGE * 30)
    assert np.allclose(model.label([page])[0], model.label([page], cells=50)[0], atol=1e-4)
    assert sum(map(len, model.label([page[:n] for n in (1, 7, 40, 300)], cells=100))) == 348


def test_html_text(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>bold <i"), (None, "u", "<!-- only -->"), (5, "u", "a < b & c"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    out = html_extract.extract_text(df).collect()
    one = [r for r in out if r.page_id == 1]
    want = "A title & more\n\nFirst paragraph of the text, it has words.\n\nSecond paragraph <here> with enough words to read. Same block."
    assert len(out) == 7 and [r.text for r in one] == [want, want] and one[0].n_chars == len(want)
    assert {r.text for r in out if r.page_id in (2, 3, None)} == {""}
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_articles(spark):
    out = html_extract.extract_text(spark.read.parquet(f"{SF}/pages.parquet"))
    for r in out.join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == "\n\n".join(t for path, t, _ in html_extract.blocks(r.html) if "article" in path)


def test_lstm_gradients():
    rng, m = np.random.default_rng(0), html_extract.Labeller(1)
    width = html_extract.PATH_DIMS + html_extract.WORD_DIMS + html_extract.SHAPE_DIMS
    x, mask = html_extract.padded([rng.normal(size=(4, width)).astype(np.float32), rng.normal(size=(2, width)).astype(np.float32)])
    y = np.array([[1, 0], [0, 1], [1, 0], [0, 0]], np.float32)

    def loss():
        p = m.forward(x, mask)
        return float(-(mask[..., 0] * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    grads = m.gradients(x, mask, y)
    for k in ("hf", "hb", "cf", "o"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-2
        up = loss()
        m.p[k][at] = old - 1e-2
        assert (up - loss()) / 2e-2 == pytest.approx(float(grads[k][at]), rel=0.05, abs=1e-4)
        m.p[k][at] = old


# -- 8 -----------------------------------------------------------------------------


def test_prefix_counts(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    more = [" lead", "a  b   c ", "\n\n x\n", "▁▁hello ▁", "<s> </s><0x0A>", "1234 56.78", "don't", "x" * 100, "\t tab", "l'été, où?", "    code = 5;"]
    data = awkward() + [(100 + i, t, "en", "s", 0, *"xxxxxx") for i, t in enumerate(more)]
    for r in token_counts.count_tokens(documents(spark, data), path, budget=20).collect():
        texts = [t for i, t, *_ in data if i == r.doc_id]
        text = next(t or "" for t in texts if r.n_bytes == len((t or "").encode()))
        assert r.n_tokens == len(sp.encode(text))
        if len(text) < 500:
            want = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
            assert token_counts.prefix_counts(r.prefix_deltas).tolist() == want
            assert r.fits_chars == max(i for i, n in enumerate(want) if n <= 20)
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


# -- 9 -----------------------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "CC BY 4.0; General Public License! all rights  reserved, ALL RIGHTS RESERVED", "Releesed under the MIT licence", "cc-bye general public licenses",
        "licensed under CC BY-NC 4.0", "gnu lesser general public license: licensed under the GNU lesser general public license", None, "", "allrights reserved é cc by",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        got = out[i]
        assert (got.n_words, got.n_base) == (len(words), len(places))
        assert (got.first_word, got.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(",")) and 0 <= got.score <= 1
    assert out[0].labels == "mit" and out[2].labels == "mit" and 0.8 < out[2].score < 1
    assert out[4].labels == "cc-by,cc-by-nc" and out[5].labels == "gpl,lgpl" and out[3].labels == "" and out[6].score == 0
    span = out[0].spans[0]
    assert (span.first_word, span.last_word, span.edits) == (0, 4, 0)
    assert license_scan.scan_licenses(documents(spark)).count() == len(awkward())


def test_license_scan_gives_every_occurrence():
    """Worse matches of a notice before and behind a better one, all within one joined window."""
    texts = ["licensed under thee mit license", "licensed under the mit license", "licensd under the mit lcense"]
    _, found = license_scan.Scanner().scan(license_scan.normalize(" ".join(texts)))
    assert [(label, edits) for _, _, label, edits, notice in found if notice == texts[1]] == [("mit", 1), ("mit", 0), ("mit", 2)]


def test_license_words_that_tell_apart():
    """An edit makes no licence of another one's name."""
    scan = license_scan.Scanner().scan
    for name, want in {"isc": {"isc"}, "mpl": set(), "bsl": set(), "mlt": set(), "mit": {"mit"}, "bsd": {"bsd"}}.items():
        for how in ("released", "licensed"):
            got = {x[2] for x in scan(license_scan.normalize(f"it is {how} under the {name} license now"))[1]}
            assert got <= want and (how == "released" or got == want)


def test_license_scan_against_every_window():
    """Fuzzy labels against edit distances of all windows of a text."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r, scanner = random.Random(6), license_scan.Scanner()
    for _ in range(30):
        notice = r.choice(list(scanner.notices))
        text = list(notice)
        for _ in range(r.randrange(5)):
            p = r.randrange(len(text))
            text[p : p + 1] = r.choice([[], ["q"], [text[p], "q"]])
        words = license_scan.normalize(prose(r.randrange(99), 4) + " " + "".join(text) + " " + prose(r.randrange(99), 4))
        most = scanner.edits[notice]
        best = min(distance(notice, words[i : i + n]) for n in range(len(notice) - most, len(notice) + most + 1) for i in range(len(words) - n + 1))
        told = all(f" {w} " in words for w in scanner.telling[notice])
        found = [x for x in scanner.scan(words)[1] if x[4] == notice]
        assert all(distance(notice, words[x[0] : x[1]]) <= x[3] <= most for x in found)
        # a match of another notice with fewer edits may stand in its place
        assert best > most or not told or any(x[2] == scanner.notices[notice] for x in scanner.scan(words)[1])


@pytest.mark.parametrize("what", ["notices", "same letters", "markup"])
def test_time_grows_with_the_text(what):
    """Four times the text takes far less than sixteen times the time."""
    import time

    def run(n):
        if what == "notices":
            words = license_scan.normalize("released under the mit license and licensed under the bsd licence " * (n // 64))
            return lambda: license_scan.Scanner().scan(words)
        if what == "same letters":
            counter, text = token_counts.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model")), pa.array(["a" * (n // 2)])
            return lambda: counter.deltas(text)
        page = ('<p class="x>Hello <b' + " a='" + "<p a=\" <iframe>") * (n // 40)
        return lambda: html_extract.blocks(page)

    took = []
    for n in (1 << 18, 1 << 20):
        job = run(n)
        began = time.perf_counter()
        job()
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


# -- 10 ----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 5).flatmap(lambda k: st.tuples(st.lists(st.integers(0, k), max_size=25), st.lists(st.integers(0, k), max_size=25))))
def test_tiles_are_complete(pair):
    a, b = pair
    used, taken = set(), set()
    for x, y, n in decontaminate.tiles(a, b, 3):
        assert n >= 3 and a[x : x + n] == b[y : y + n]
        assert not used & set(range(x, x + n)) and not taken & set(range(y, y + n))
        used |= set(range(x, x + n))
        taken |= set(range(y, y + n))
    for x in range(len(a) - 2):
        for y in range(len(b) - 2):
            assert any(a[x + k] != b[y + k] or x + k in used or y + k in taken for k in range(3))


def test_leaks(spark, monkeypatch):
    items = [(i, prose(100 + i, 40)) for i in range(6)] + [(90, "too short"), (91, None)]
    words = items[0][1].split()
    turned = " ".join(words[25:] + ["so"] + words[10:25] + ["and"] + words[:10])
    texts = [prose(1, 50) + " " + items[0][1] + " tail", turned, " ".join(words[:18]) + " " + prose(5, 80), items[1][1].upper().replace(" ", ", "), prose(9, 500), None, "", "too short", items[2][1] + " x " + items[3][1]]
    docs = documents(spark, [(i, t, "en", "s", 0, *"xxxxxx") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    want = [(0, 0), (1, 0), (3, 1), (8, 2), (8, 3)]
    assert rows(decontaminate.find_leaks(docs, bench), "doc_id", "item_id") == want
    assert rows(decontaminate.find_leaks(docs, bench, shard_bytes=300), "doc_id", "item_id") == want
    assert [r[0] for r in rows(decontaminate.decontaminate(docs, bench), "doc_id")] == [2, 4, 5, 6, 7]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(documents(spark), bench).count() == 0


def test_leaks_in_scripts_without_blanks(spark):
    docs = spark.createDataFrame([(2, "昨日は天気が良かったので公園を散歩しました。"), (4, "ก็วันนี้อากาศดีมากจริงๆ"), (5, "天気")], "doc_id long, text string")
    bench = spark.createDataFrame([(11, "天気が良かったので公園を散歩"), (12, "วันนี้อากาศดีมาก"), (13, ""), (14, None)], "item_id long, text string")
    assert rows(decontaminate.find_leaks(docs, bench), "doc_id", "item_id") == [(2, 11), (4, 12)]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [5]


def test_html_elements_without_end_tag():
    texts = lambda html: [t for _, t, _ in html_extract.blocks(html)]
    for name in ("video", "object", "svg", "canvas"):
        assert texts(f"<div><p>one <{name} class=x>not shown</p><p>two</p></div><p>three<{name}>no</{name}> four</p>") == ["one", "two", "three four"]
        assert texts(f"<div><{name}><{name}>no</{name}>no</{name}>yes<p>a<{name}><p>no</p></{name}>b</p></div>") == ["yes", "ab"]
    assert texts("<p>one</p><script>var x = '<p>two</p>'") == ["one"]
