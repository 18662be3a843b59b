"""BPE and token files against the public libraries, round trip."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import tiktoken
from conftest_llm import sample_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")
BPE = byte_bpe.coder(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
ENCODER = token_files.encoder(P.path("byte_bpe_50k.json"))
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(packed, kind="<u4"):
    return np.frombuffer(packed, kind).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aeiou.,sdtl")), max_size=60), max_size=5))
def test_encoders_equal_the_libraries(texts):
    assert [ids(p) for p in BPE.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert [ids(p, ENCODER.dtype) for p in ENCODER.encode(texts)] == [e.ids for e in HF.encode_batch(texts, add_special_tokens=False)]
    decode = BPE.decode
    assert [decode(p).decode() for p in BPE.encode(texts)] == texts


def test_long_and_tied_pretokens():
    for piece in ("a" * 5000, "ab" * 3000, "aaabaaab" * 50, "z" * 63, "z" * 64, "z" * 65, "é" * 40):
        assert ids(BPE.encode([piece])[0]) == TIKTOKEN.encode_ordinary(piece)
        assert BPE.merge(piece.encode()) == ids(BPE.merge_many([piece.encode()])[0])


def test_special_token_strings_as_the_library_has_them():
    texts = ["a \0a \0 a\0", "a \u0120a\n\u0120a \u010aa", "end <|endoftext|> more", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", " <|endoftext|>\n"]
    assert [ids(p, ENCODER.dtype) for p in ENCODER.encode(texts)] == [e.ids for e in HF.encode_batch(texts, add_special_tokens=False)]
    assert ids(ENCODER.encode(texts)[2], ENCODER.dtype) == [437, 220, 50256, 517]


def test_caches_are_bounded_by_bytes(monkeypatch):
    for module, own in ((byte_bpe, byte_bpe.ByteBpe(byte_bpe.Tables(BPE.ranks, P.PATTERN))), (token_files, token_files.ChunkEncoder(Tokenizer.from_file(P.path("byte_bpe_50k.json"))))):
        monkeypatch.setattr(module, "CACHE_BYTES", 20_000)
        for i in range(30):
            texts = [f"{'long' * 500}{i} and{i} some{i}"]
            assert [ids(p, "<u4" if module is byte_bpe else own.dtype) for p in own.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
        held, entries = (own.cached, own.packed) if module is byte_bpe else (own.chunks.held, own.chunks)
        assert held <= 30_000 and len(entries) < 90


def test_long_texts_are_split_in_parts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SPLIT_TOKENS", 10)
    text = "Some words, 12 of them\n\n and more " * 7
    assert ids(BPE.encode([text, "x"])[0]) == TIKTOKEN.encode_ordinary(text)


def test_byte_bpe_frame(docs, no_docs):
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, keep=["doc_id"]), RANKS)
    got = Counter((r.doc_id, tuple(ids(r.ids)), bytes(r.decoded)) for r in out.collect())
    assert got == Counter((i, tuple(TIKTOKEN.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in sample_rows())
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN, keep=["doc_id"]).count() == 0


def test_token_files(spark, docs, no_docs):
    manifest = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    start = 0
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == start
        start += len(ids(r.ids))
    want = Counter((i, tuple([*HF.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, _, _ in sample_rows())
    assert Counter((r.doc_id, tuple(ids(r.ids))) for r in got) == want
    empty = token_files.write_token_files(no_docs, P.path("byte_bpe_50k.json"))
    assert empty.count() == 0 and token_files.read_token_files(spark, empty).count() == 0


def test_files_are_read_by_a_task_each(spark):
    docs = spark.range(0, 4000, 1, 16).selectExpr("7L as doc_id", "repeat(cast(id as string), 300) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = token_files.read_token_files(spark, manifest)
    files = manifest.count()
    assert files > 1  # rows that repeat an id are not one file
    assert read.rdd.getNumPartitions() == files
    assert read.count() == 4000


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    rng = random.Random(3)
    parts = ["word", "don't", "x", "***", "'", "9", "é", "日本", "\n", " ", "  ", "\n\n", "\t", "\xa0", "\u3000 ", "<|endoftext|>", "<|endof", "...", "a.b.c", "\x1c", "🙂"]
    for size in (40, 12):
        monkeypatch.setattr(token_files, "PACK_CHARS", size)
        own = token_files.ChunkEncoder(HF)
        texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.choice([5, 40, 200]))) for _ in range(150)]
        assert [ids(p, own.dtype) for p in own.encode(texts)] == [e.ids for e in HF.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_a_long_text_with_two_spaces():
    """A worker of its own: 32 MB of text, of which the tokenizer alone would hold gigabytes."""
    code = "import resource, public_tokenizers as P; from gridloom.llm import token_files as t; own = t.encoder(P.path('byte_bpe_50k.json')); text = 'some  words here, ' * (32 << 20 >> 4); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = len(own.encode([text])[0]); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10, n)"
    used, size = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(token_files.__file__).parents[2]).stdout.split()[-2:])
    assert used < 200 and size > 16 << 20


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_signs_stand_beside_them():
    words = [f"{a}{b}lïñ{c}o" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuv"]
    signs = ["", ",", ".", "...", ")", "?!", ":", ";", "/", "-", ".\nThen", "%%%", "12"]
    texts = [" ".join(["first", *(w + s for w in words)]) for s in signs]
    counted = Counted(HF)
    own = token_files.ChunkEncoder(counted)
    assert [ids(p, own.dtype) for p in own.encode(texts)] == [e.ids for e in HF.encode_batch(texts, add_special_tokens=False)]
    assert counted.chars < 2 * sum(len(w) + 1 for w in words)


def test_runs_of_letters_digits_and_signs_as_the_library_has_them(monkeypatch):
    rng = random.Random(5)
    parts = [*"aZéßÿĀɏɿЖяѿӿ", *"0129", *".,-/*_%|~", *"'ªºµ×÷²½\u0301҂ʰΩ日\u0120\u010a\x1c\t\x7f\xad", "\n", "\n", "\n", "don't", "'s", "word", "12"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 8]))) for _ in range(rng.choice([1, 2, 6, 40]))) for _ in range(3000)]
    monkeypatch.setattr(token_files, "RUN_BYTES", 5000)
    own = token_files.ChunkEncoder(HF)
    for some in (texts, texts[:1], [""], [" "], ["a "], [" a"], ["a \n"], ["a b\n"], []):
        assert [ids(p, own.dtype) for p in own.encode(some)] == [e.ids for e in HF.encode_batch(some, add_special_tokens=False)]


def test_letters_that_may_be_cut_at_are_letters_to_the_library():
    split = HF.pre_tokenizer.pre_tokenize_str
    for number in (*range(33, 0x280), *range(0x400, 0x530)):
        char = chr(number)
        data = np.frombuffer(f"a{char}a.{char}.1{char}1".encode(), np.uint8)
        cuts = token_files._runs(data, np.array([0, len(data)]))
        pieces = [p for p, _ in split(f"a{char}a.{char}.1{char}1")]
        if len(cuts):
            ends = np.cumsum([len(p) for p in pieces])  # a letter of the byte-level alphabet is a byte
            assert cuts.tolist() == ends[:-1].tolist(), char


def test_memory_of_texts_that_are_all_runs():
    """A worker of its own: 4 MB without spaces, where each byte is a pre-token."""
    code = "import random, resource, public_tokenizers as P; from gridloom.llm import token_files as t; own = t.encoder(P.path('byte_bpe_50k.json')); r = random.Random(1); texts = ['x ' + ''.join(r.choice('abc') + r.choice('.,-') for _ in range(130_000)) for _ in range(16)]; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = sum(map(len, own.encode(texts))); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10, n)"
    used, size = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(token_files.__file__).parents[2]).stdout.split()[-2:])
    assert used < 125 and size > 8 << 20 >> 1
