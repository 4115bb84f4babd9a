"""Exact, substring, suffix and near dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from ibex.llm.components import connected_components
from ibex.llm.exact_dedup import drop_copies, exact_dedup
from ibex.llm.near_dedup import NearDedup, drop_near_copies, minwise, near_dedup
from ibex.llm.substring_dedup import substring_dedup
from ibex.llm.suffix_dedup import suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sf(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def pairs_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]


# --- exact -----------------------------------------------------------------

def exact_expected(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in docs}
    first, size = {}, Counter(norm.values())
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    return {i: (first[t], size[t], first[t] == i, sha(t.encode())) for i, t in norm.items()}


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_exact(spark, odd, table):
    frame = odd if table == "odd" else sf(spark)
    got = {r.id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame).collect()}
    assert got == exact_expected(pairs_of(frame))


def test_exact_prefix_does_not_decide(spark):
    long = "p" * 300
    frame = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "a")], "doc_id long, text string")
    assert {r.id: r.keep_id for r in exact_dedup(frame, prefix=8).collect()} == {1: 1, 2: 2, 3: 1}


def test_exact_odd_ids_and_empty(spark, no_ids, nothing, odd):
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(no_ids).collect()), key=repr)
    assert got == sorted([(None, 7, 4, False)] * 2 + [(7, 7, 4, True)] * 2 + [(7, 7, 2, True), (9, 7, 2, False), (None, None, 1, True)], key=repr)
    assert exact_dedup(nothing).count() == 0 and drop_copies(nothing).count() == 0
    assert drop_copies(odd).columns == odd.columns
    assert {r.doc_id for r in drop_copies(odd).collect()} == {i for i, x in exact_expected(pairs_of(odd)).items() if x[2]}


def test_exact_plan_is_native(odd):
    plan = exact_dedup(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- substring -------------------------------------------------------------

def substring_expected(docs, width):
    words = [(i, WORD.findall(t)) for i, t in docs]
    seen = Counter(tuple(w[k:k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [
    {}, {"bucket_bytes": 2000, "cell_bits": 10, "exact_per_shard": 16}, {"bucket_bytes": 2000, "cell_bits": 4, "depth": 1}, {"width": 3, "bucket_bytes": 5000}])
def test_substring(odd, options):
    got = sorted((tuple(r) for r in substring_dedup(odd, **options).collect()), key=repr)
    assert got == substring_expected(pairs_of(odd), options.get("width", 35))


def test_substring_odd_ids_and_empty(no_ids, nothing):
    got = sorted((tuple(r) for r in substring_dedup(no_ids, bucket_bytes=100).collect()), key=repr)
    assert got == substring_expected(pairs_of(no_ids), 35)
    assert substring_dedup(nothing).count() == 0


def test_text_is_shuffled_once(spark):
    frame = substring_dedup(sf(spark))
    frame.collect()
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


# --- suffix ----------------------------------------------------------------

def suffix_expected(docs, width):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k:k + width] in seen:
                gone[k:k + width] = b"\1" * width
            else:
                seen.add(b[k:k + width])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(kept), kept))
    return sorted(out, key=repr)


def suffix_got(frame, **options):
    return sorted(((*tuple(r)[:5], bytes(r.kept)) for r in suffix_dedup(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [
    {}, {"bucket_bytes": 2000, "cell_bits": 8, "entries_per_shard": 16}, {"width": 12, "gram": 5, "bucket_bytes": 3000}, {"width": 7, "gram": 7}])
def test_suffix(odd, options):
    assert suffix_got(odd, **options) == suffix_expected(pairs_of(odd), options.get("width", 100))


def test_suffix_real_rows_and_odd_ids(spark, no_ids, nothing):
    frame = sf(spark).where("n_chars < 3000")
    assert suffix_got(frame, bucket_bytes=30_000) == suffix_expected(pairs_of(frame), 100)
    assert suffix_got(no_ids, bucket_bytes=100) == suffix_expected(pairs_of(no_ids), 100)
    assert suffix_dedup(nothing).count() == 0


# --- near ------------------------------------------------------------------

def near_expected(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                a0, b0 = root(a), root(b)
                parent[max(a0, b0)] = min(a0, b0)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("options", [{}, {"node_limit": 2, "max_depth": 3}, {"node_limit": 1, "max_depth": 1, "pairs_per_set": 1}])
def test_near(odd, options):
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(odd, **options).collect()}
    assert got == near_expected(pairs_of(odd))


def chain_rows():
    """Copies that drift: each is close to the next, the ends are not; and a
    hub whose copies are not close to one another."""
    words = [f"w{i}" for i in range(100)]
    out = []
    for k in range(12):
        out.append((100 + k, " ".join([f"c{j}" for j in range(3 * k)] + words[3 * k:])))
    for k in range(40):
        body = [f"h{i}" for i in range(200)]
        body[5 * k % 200] = f"x{k}"
        body[(5 * k + 70) % 200] = f"y{k}"
        out.append((500 + k, " ".join(body)))
    out.append((900, " ".join(f"h{i}" for i in range(200))))
    return out


@pytest.mark.parametrize("options", [{}, {"node_limit": 4, "max_depth": 2}])
def test_near_chains_and_hubs(spark, options):
    docs = chain_rows()
    got = {r.id: r.component_id for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}
    assert got == {i: x[1] for i, x in near_expected(docs).items()}


def test_near_empty_and_columns(nothing, odd, no_ids):
    assert near_dedup(nothing).count() == 0 and drop_near_copies(nothing).count() == 0
    assert drop_near_copies(odd).columns == odd.columns
    got = sorted(((r.id, r.component_id, r.kept) for r in near_dedup(no_ids).collect()), key=repr)
    assert got == sorted([(None, 7, False)] * 2 + [(7, 7, True)] * 3 + [(9, 7, False), (None, None, True)], key=repr)


def test_sketches_let_links_pass():
    rng = np.random.default_rng(0)
    join = NearDedup(sketch=256)
    for size, share, passes in ((200, 0.9, True), (200, 0.75, True), (200, 0.5, False), (4000, 0.85, True), (4000, 0.5, False)):
        both = int(round(2 * size * share / (1 + share)))
        pool = rng.integers(0, 1 << 32, 3 * size, dtype=np.uint32)
        a, b = pool[:size], np.concatenate([pool[:both], pool[size:2 * size - both]])
        a, b = (np.unique(x)[:256].tobytes() for x in (a, b))
        assert join._similar(a, b) == passes == join._similar(b, a), (size, share)


def test_minwise_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    first, rest = minwise([pool[:1000], pool[150:1150]], 256, 16)
    same = (first[0] == first[1]).sum() + (rest[0] == rest[1]).sum()
    assert abs(same / 256 - 850 / 1150) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (7, 8), (20, 20), (4, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, **{i: 7 for i in (7, 8, 9, 10)}, **{i: 100 for i in range(100, 161)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
