"""The rows of the whole pipeline against a version of each stage in plain Python, SQL or a public library."""

import hashlib
import re
from array import array
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import tiktoken
from test_dedup import brute_fingerprint, components

import corpus_pipeline
from gridloom.llm import byte_bpe, queries, toxicity

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # Toxicity has a brute-force test of its score; here the rows that a score drops.
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
    rows = [r for r in scored if r.score < corpus_pipeline.TOXIC]
    # Exact copies: the smallest id of each normalised text.
    best = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    rows = list(best.values())
    # Near copies: the smallest id of each component of close fingerprints.
    rows.sort(key=lambda r: r.doc_id)
    roots = components(np.array([brute_fingerprint(r.text) for r in rows], np.uint64))
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    # Mixing by its SQL, then each document as often as it says.
    documents = pa.table({c: [r[c] for r in rows] for c in docs.columns})
    copies = {r[0]: r[1] for r in duckdb.connect().execute(f"SELECT doc_id, copies FROM ({queries.OP7_SQL})").fetchall()} if documents.num_rows else {}
    ranks = byte_bpe.load_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, r.lang, r.source, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), True] += copies[r.doc_id]
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "round_trip").collect()
    assert Counter(map(tuple, got)) == +want
