"""Removal of copies and near copies against brute force, with repeated and null ids."""

from collections import Counter

from conftest_llm import make_docs

import corpus_pipeline
from gridloom.llm import simhash


def test_stages_keep_one_row_of_each_group(spark):
    text = ["one two three four five six", "red green blue white black grey", "sun moon star sky rain snow", "cat dog cow pig hen fox"]
    rows = [(1, text[0], "en", "a"), (2, text[0].upper(), "en", "b"), (2, text[1], "en", "c"), (3, text[2], "en", "a"), (3, text[2].title(), "en", "b")]
    rows += [(None, text[1].upper(), "en", "d"), (None, text[3], "en", "e"), (None, text[3].upper(), "en", "f"), (7, text[0], "en", "g"), (None, text[0], "en", "h")]
    docs = make_docs(spark, rows).repartition(3)
    once = corpus_pipeline.drop_copies(spark, docs, "").collect()
    least = {}
    for i, t, *_ in rows:
        least[t] = min(least.get(t, 1e9), 1e9 if i is None else i)
    assert Counter((r.text, 1e9 if r.doc_id is None else r.doc_id) for r in once) == Counter(least.items())
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(once, docs.schema), "").collect()
    fps = [simhash.fingerprint(r.text.encode()) for r in once]
    group = list(range(len(once)))
    for a in range(len(once)):
        for b in range(a):
            if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= simhash.DISTANCE:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, once, strict=True):
        best[g] = min(best.get(g, 1e9), 1e9 if r.doc_id is None else r.doc_id)
    place = {r.text: g for g, r in zip(group, once, strict=True)}
    assert {place[r.text]: 1e9 if r.doc_id is None else r.doc_id for r in kept} == best and len(kept) == len(best) == 4
