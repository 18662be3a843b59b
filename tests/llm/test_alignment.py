"""Alignment of two tokenizers against a plain walk over token ends."""

import collections
import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import public_tokenizers as P
import sentencepiece
from conftest_llm import make_docs, sample_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
PLAIN = {chr(b): b for b in range(256) if b not in ODD} | {chr(256 + i): b for i, b in enumerate(ODD)}


def groups_of(text):
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelled = [[bytes(PLAIN[c] for c in A.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(B.id_to_piece, b)]]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
    out, i, k = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        j, m = bisect_right(ends[0], cut), bisect_right(ends[1], cut)
        out.append((a[i:j], b[k:m]))
        i, k = j, m
    return out


def brute(rows):
    docs = [(i, groups_of(t)) for i, t in rows]
    counts = collections.Counter()
    for _, groups in docs:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


PARTS = ["the", "don't", "x's", "abc9def", "é", "日本語", "🙂", "***", "&&", "...", "'***abc", "\n", "\n\n", "\t", "  ", "   ", " ", "\r\n", "\xa0", "▁", "<s>", "<|endoftext|>", "a", "Word", "9", "12.5", ";\r", "\x00", "\x1c", "(x)", "_name", "…", "ﬁ", "aé́", "　", " \n", "q.\nR", " "]


def texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", "", " "]) for _ in range(rng.choice([1, 2, 3, 8, 30]))) for _ in range(count)]


def aligned(own, given):
    f = own.align(given)
    return list(zip(f["n_a"].tolist(), f["n_b"].tolist(), f["n_groups"].tolist(), f["n_links"].tolist(), [x.hex() for x in f["sha"]], strict=True))


def wanted(given):
    return [(*row[1:5], row[7]) for t in given for row in brute([(0, t)])]


def test_spans_align_as_whole_texts_do(monkeypatch):
    own = alignment.Aligner(*PATHS)
    given = [*texts(5, 500), "", " ", "\n", "  ", " x", "a " * 3000, "abc" * 2000]
    assert aligned(own, given) == wanted(given)
    for name, value in (("PACK_CHARS", 50), ("WRITTEN_SPANS", 7), ("GROUP_LINKS", 2), ("CACHE_BYTES", 5_000)):
        monkeypatch.setattr(alignment, name, value)
    own.clear()
    for x in range(0, len(given), 20):
        assert aligned(own, given[x : x + 20]) == wanted(given[x : x + 20])
        assert len(own.number) < 2_000


OWN = alignment.aligner(*PATHS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aeiou.,sdtl*")), max_size=40), max_size=4))
def test_any_text(given):
    assert aligned(OWN, given) == wanted(given)


def test_packed_bitsets_give_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 64, 1000):
        a, b = (np.unique(np.append(rng.integers(1, n + 1, n // 2 + 1), n)) for _ in range(2))
        cuts, to_a, to_b = alignment.shared_cuts(a, b)
        assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert [(sum(a <= c), sum(b <= c)) for c in cuts] == list(zip(to_a.tolist(), to_b.tolist(), strict=True))


def test_corpus_counts_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in sample_rows(3, 60) if r[1] is None or len(r[1]) < 10_000]
    rows += [(3000 + i, t) for i, t in enumerate(texts(9, 80))] + [(None, None), (4000, "same text here"), (4000, "same text here"), (4001, "long word " * 9_000)]
    docs = make_docs(spark, [(*r, "en", "a") for r in rows]).repartition(4)
    for entries in (alignment.BLOCK_ENTRIES, 300):
        got = alignment.align(docs, *PATHS, entries=entries)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert alignment.align(docs.limit(0), *PATHS).count() == 0
