"""Exact and near dedup against brute force."""

import hashlib
import random
import re
from math import comb
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import make_docs, sample_rows

from gridloom.llm import exact_dedup, simhash


def test_exact_dedup(docs):
    rows = sample_rows()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, _, _ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_dedup(docs).collect()
    want = Counter((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, norm, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_carries_whole_rows(docs):
    kept = exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0


def test_texts_that_differ_late(spark):
    """Equal lengths, differences beyond each digit of the radix."""
    base = "a" * 5000
    texts = [base[:k] + "b" + base[k + 1 :] for k in (0, 63, 64, 575, 576, 4671, 4672, 4999)] + [base, base]
    got = exact_dedup.exact_dedup(make_docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i, 1) for i in range(8)} | {(8, 8, 2), (9, 8, 2)}


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \t", "one", "One two THREE four", "É A b c d e f g a b c d", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) % (1 << 64) == brute_fingerprint(text)


def components(values, distance=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(docs):
    rows = [r for r in sample_rows()]
    values = np.array([brute_fingerprint(t) for _, t, _, _ in rows], np.uint64)
    roots = components(values)
    least = {}
    for root, (i, *_) in zip(roots, rows, strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = Counter((i, int(v.view(np.int64)), least.get(root)) for (i, *_), v, root in zip(rows, values, roots, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("spread,limit,blocks", [(3, 200_000, None), (40, 50, None), (40, 200_000, 6), (3, 50, 7), (40, 200_000, 8)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, spread, limit, blocks):
    """Dense clusters, and buckets that are cut into chunks."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    rng = np.random.default_rng(spread)
    values = rng.integers(0, 2**63, spread, dtype=np.uint64)[rng.integers(0, spread, 700)]
    for _ in range(4):
        values ^= np.where(rng.random(700) < 0.8, np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64), np.uint64(0))
    values = np.unique(values)
    edges = simhash.linked(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), blocks=blocks).collect()
    parent = {int(v): int(v) for v in values.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.src)] = find(e.dst)
    ours, want = defaultdict(set), defaultdict(set)
    for v, root in zip(values.view(np.int64).tolist(), components(values), strict=True):
        ours[find(v)].add(v)
        want[root].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))
    assert len(edges) <= comb(blocks or 5, 4) * len(values) * (1 if limit > 700 else 60)


def test_buckets_stay_small_as_values_grow():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**7, 10**9, 10**10, 10**13)] == [5, 5, 6, 7, 7, 9]


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def test_copies_in_any_order(spark):
    rows = [(i, "same text here with some words", "en", "s") for i in range(30)]
    random.Random(3).shuffle(rows)
    got = simhash.near_duplicates(make_docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
