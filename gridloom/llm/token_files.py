"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Documents are range-partitioned and sorted by id, so file order is id order. Each task encodes its documents and writes
one ``.bin`` file of ids (16 bits each where the vocabulary fits, else 32), one ``.idx`` file of 64-bit offsets and one
row of the manifest. Prefix sums over the manifest (one row per file) give the partition bases; no text or id passes
through the driver.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom import storage
from gridloom.session import materialize, new_folder

from .batches import BATCH_BYTES, release, strings

#: Bytes of a worker's cache (about), and what an entry takes beside its text and ids.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 200
#: Characters that the tokenizer encodes at a time: it holds far more than the ids of a text.
PACK_CHARS = 1 << 18
#: Chunks that go to a worker's cache at a time.
KEPT = 4096
#: Bytes of distinct chunks that are searched for runs at a time: each byte may be one.
RUN_BYTES = 1 << 20
#: Most tasks that read files.
READ_TASKS = 20_000
#: Bytes of ids that a task holds before they go to the file.
BUFFER_BYTES = 8 << 20

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a pre-token always ends: before white space behind something else, and between a letter and a mark.
_END = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[A-Za-z])(?=[!-&(-/:-@[-`{{-~])")
_TWO_SPACES = re.compile(r"\s\s").search
#: How the byte-level alphabet spells what pieces follow.
_SPELT = {" ": "\u0120", "\n": "\u010a"}

# What a byte of UTF-8 belongs to. Of letters beyond ASCII, those whose first byte stands for letters only.
_OTHER, _LETTER, _DIGIT, _SIGN, _LINE = range(5)
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _SIGN
_KINDS[ord("'")] = _OTHER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _KINDS[0x80:0xC0] = _KINDS[0xC3:0xCA] = _KINDS[[0xD0, 0xD1, 0xD3]] = _LETTER
_KINDS[ord("\n")] = _LINE


class Chunks:
    """The ids of pieces of text, each as it follows a space, or a line end that its own ids leave out (``lead``); a cache
    of two generations, bounded by their bytes (``share`` of CACHE_BYTES).

    When the younger one has taken half of them it becomes the older one, whose pieces are carried over as they are met
    again: common words stay, whatever number of rare ones passes.
    """

    def __init__(self, tokenizer, kind: str, added: re.Pattern | None, lead: str = " ", share: float = 1):
        self.tokenizer, self.kind, self.added = tokenizer, kind, added
        self.lead, self.share = lead, share
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        # Whether an id's token begins with the lead, which the byte-level alphabet spells as its own letter.
        self.begins = np.zeros(tokenizer.get_vocab_size(), bool)
        self.begins[[number for token, number in tokenizer.get_vocab().items() if token.startswith(_SPELT[lead])]] = True

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def look(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks without spaces."""
        found = list(map(self.young.get, chunks))
        unmet = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unmet, map(self.old.get, [chunks[i] for i in unmet]), strict=True):
            found[i] = ids
        new = [i for i in unmet if found[i] is None]
        for i, ids in zip(new, self._encoded([chunks[i] for i in new]), strict=True):
            found[i] = ids
        for first in range(0, len(unmet), KEPT):
            part = unmet[first : first + KEPT]
            self._keep([chunks[i] for i in part], [found[i] for i in part])
        return found

    def _keep(self, chunks: list[str], ids: list[bytes]) -> None:
        size = sum(map(len, chunks)) + sum(map(len, ids)) + ENTRY_BYTES * len(chunks)
        if self.held + size > CACHE_BYTES * self.share // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += size
        self.young.update(zip(chunks, ids, strict=True))

    def _encoded(self, chunks: list[str]) -> Iterator[bytes]:
        """The ids of chunks, many to a text where each begins with the only tokens that begin with the lead."""
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        first = 0
        while first < len(chunks):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PACK_CHARS, "right")))
            group = chunks[first:last]
            yield from self._together(group) or self._apart(group)
            first = last

    def _apart(self, group: list[str]) -> Iterator[bytes]:
        """The ids of chunks that are encoded one by one."""
        texts = [" " + c for c in group] if self.lead == " " else group
        return (array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _together(self, group: list[str]) -> list[bytes] | None:
        """The ids of chunks that are encoded as one text, if that can be told apart."""
        lent = [not c.startswith(self.lead) for c in group]
        text = "".join(self.lead + c if own else c for own, c in zip(lent, group, strict=True))
        if _TWO_SPACES(text) or text[-1].isspace() or (self.added and self.added.search(text)):
            return None
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(group):
            return None
        packed, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        begins = cuts if self.lead == " " else cuts + lent
        return [packed[x:y] for x, y in zip((begins * width).tolist(), [*(cuts[1:] * width).tolist(), len(packed)], strict=True)]


def _runs(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin within chunks of UTF-8 text, each from a bound to the next, besides where these begin.

    Chunks of Latin and Cyrillic letters, digits, signs other than the apostrophe, and single line ends between them:
    there, runs of one kind are pre-tokens, a line end goes with what follows it. Other chunks stay whole.
    """
    kinds = _KINDS[data]
    other = kinds == _OTHER
    if len(data) > 1:  # multiplication and division signs among letters
        other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    line = kinds == _LINE
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    other[bounds[full]] |= line[bounds[full]]
    other[bounds[full + 1] - 1] |= line[bounds[full + 1] - 1]
    before = np.concatenate([[0], np.cumsum(other)])
    whole = before[bounds[1:]] > before[bounds[:-1]]
    changes = kinds[1:] != kinds[:-1]
    changes &= ~line[:-1]
    starts = bounds[(bounds > 0) & (bounds < len(data))]
    changes[starts - 1] = False
    cuts = np.flatnonzero(changes) + 1
    return cuts[~whole[np.searchsorted(bounds, cuts, "right") - 1]]


def _bounds(column: pa.LargeStringArray | pa.LargeBinaryArray) -> np.ndarray:
    """Where each of a column's values begins in its buffer, and where the last one ends."""
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def _bytes_of(column: pa.LargeStringArray | pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """The bytes of a column's values, and where each begins in them and the last one ends."""
    ends, data = _bounds(column), column.buffers()[2]
    return (data[ends[0] : ends[-1]].to_pybytes() if data else b""), ends - ends[0]


class ChunkEncoder:
    """Encodes whole texts with a tokenizers file, each distinct chunk between spaces once while it stays cached.

    The byte-level pre-tokenizer never joins a space to the non-space before it, so a text whose white-space characters
    all stand alone may be cut before each space. Arrow numbers the distinct chunks of a batch and, where runs of letters,
    digits or signs in them are pre-tokens, the distinct runs, each of which is looked up once; by these numbers it lays
    their ids out. Texts that hold the string of a token which the file adds to the vocabulary go to the tokenizer whole:
    such strings become their own ids, as with the library's defaults. A long text is taken in pieces that end where a
    pre-token does, so that memory does not grow with what the tokenizer holds of it.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        added = tokenizer.get_added_tokens_decoder()
        names = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.added_ids = {t.content: number for number, t in added.items()}
        # Strings of tokens that take white space or words around them into account cannot be cut out beforehand.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word for t in added.values()) and tokenizer.normalizer is None
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.kind == "H" else "<u4"
        self.chunks = Chunks(tokenizer, self.kind, self.added)
        self.parts = Chunks(tokenizer, self.kind, self.added, "\n", 0.25)

    def _pack(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        first = size = 0
        for last, text in enumerate(texts, 1):
            size += len(text)
            if size >= PACK_CHARS or last == len(texts):
                out += [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[first:last], add_special_tokens=False)]
                first, size = last, 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        heads: list[str] = []
        rests: list[str | None] = []
        long: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            if len(text) > PACK_CHARS:
                long[i] = b"".join(self._pieces(text))
                head, space, rest = "", "", ""
            elif _TWO_SPACES(text) or self._adds(text):
                head, space, rest = text, "", ""
            else:
                head, space, rest = text.partition(" ")
            heads.append(head)
            rests.append(rest if space else None)
        packed = zip(self._pack(heads), self._laid_out(rests), strict=True)
        return [long[i] if i in long else head + tail for i, (head, tail) in enumerate(packed)]

    def _laid_out(self, rests: list[str | None]) -> Iterator[bytes]:
        """The ids of what follows the first space of each text; nothing where it has none."""
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        numbered = lists.values.dictionary_encode()
        chunks = numbered.dictionary
        ends, first, found = _bounds(chunks), 0, []
        while first < len(chunks):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + RUN_BYTES, "right")) - 1)
            found.append(self._of_chunks(chunks[first:last]))
            first = last
        packed, ends = _bytes_of(pa.chunked_array(found, pa.large_binary()).combine_chunks().take(numbered.indices))
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return (packed[x:y] for x, y in zip(bounds, bounds[1:], strict=False))

    def _of_chunks(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct chunks, by way of the distinct pre-tokens in them where these are easily told."""
        data, bounds = _bytes_of(chunks)
        cuts = _runs(np.frombuffer(data, np.uint8), bounds)
        counts = 1 + np.bincount(np.searchsorted(bounds, cuts, "right") - 1, minlength=len(chunks))
        firsts = np.cumsum(counts) - counts
        later = np.ones(len(chunks) + len(cuts), bool)
        later[firsts] = False
        starts = np.empty(len(later) + 1, np.int64)
        starts[:-1][firsts], starts[:-1][later], starts[-1] = bounds[:-1], cuts, len(data)
        pieces = pa.LargeStringArray.from_buffers(len(later), pa.py_buffer(starts), pa.py_buffer(data))
        head, tail = pieces.take(pa.array(firsts)).dictionary_encode(), pieces.filter(pa.array(later)).dictionary_encode()
        ids = self.chunks.look(head.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = np.empty(len(later), np.int64)
        numbers[firsts], numbers[later] = head.indices.to_numpy(), tail.indices.to_numpy() + len(ids)
        ids = pa.array(ids + self.parts.look(tail.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        packed, ends = _bytes_of(ids.take(pa.array(numbers)))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends[np.append(firsts, len(later))]), pa.py_buffer(packed)])

    def _adds(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def _pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a long text, piece by piece."""
        if not self.apart:
            yield from self._pack([text])
            return
        at = 0
        for found in self.added.finditer(text) if self.added else ():
            yield from self._between(text, at, found.start())
            yield array(self.kind, [self.added_ids[found[0]]]).tobytes()
            at = found.end()
        yield from self._between(text, at, len(text))

    def _between(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """A part without added tokens, in pieces that are cut at the first end of a pre-token after half of PACK_CHARS."""
        while at < end:
            cut = _END.search(text, at + PACK_CHARS // 2, end) if end - at > PACK_CHARS // 2 else None
            to = cut.start() if cut else end
            if to - at > PACK_CHARS:  # nothing to cut at: one pre-token, or several of signs that are not looked for
                yield from self._pack([text[at:to]])
            else:
                yield from self.encode([text[at:to]])
            at = to


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker: its file is read once, and its bounded caches last from task to task."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[path] = ChunkEncoder(Tokenizer.from_file(path))
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending id order; return the manifest with each file's base.

    Per file: file (URI without extension), part, docs, tokens, base (ids in all files before). ``.bin`` holds the ids,
    ``end_id`` after each document; ``.idx`` holds an int64 header (documents, bytes per id), then docs + 1 offsets and
    docs document ids, all int64. Null texts count as empty (the end id alone); null ids sort first and read back as
    null; rows that repeat an id stand next to each other, in files of bounded size however often it occurs; an empty
    table gives an empty manifest. Very long texts are encoded in pieces. Other columns are ignored. The files lie in the
    folder that all executors share.

    Texts are encoded as the tokenizers library does by default: the string of a token that the file adds to its
    vocabulary, such as that of an end of text, becomes that token's id.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Rows that repeat an id are told apart by a hash of their text, and equal rows by their place in the input.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = ("doc_id", "tie", "place")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        part = storage.task_number()
        file = f"{folder}/tokens-{part:06d}"
        end = np.array([end_id], own.dtype).tobytes()
        width = len(end)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        with storage.atomic_output(f"{file}.bin") as sink:
            for batch in batches:
                packed = own.encode(strings(batch.column(1)))
                ids.append(np.array([_NULL_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64))
                lengths.append(np.fromiter((len(p) // width + 1 for p in packed), np.int64, len(packed)))
                for p in packed:
                    held += (p, end)
                    size += len(p) + width
                    if size >= BUFFER_BYTES:
                        sink.write(b"".join(held))
                        held, size = [], 0
            sink.write(b"".join(held))
        all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
        storage.write_bytes(f"{file}.idx", np.concatenate([[len(all_ids), width], offsets, all_ids]).astype("<i8").tobytes())
        if len(all_ids):
            release()
            yield pa.RecordBatch.from_pylist([{"file": file, "part": part, "docs": len(all_ids), "tokens": int(offsets[-1])}], pa.schema([("file", pa.string()), ("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    # One row for each file, gathered before they are written: not as many small files again.
    manifest = materialize(ordered.mapInArrow(write, MANIFEST).repartition(1), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


#: Stands for a null id in the files.
_NULL_ID = -(1 << 63)
#: Bytes of ids that a batch of documents carries when files are read.
READ_BYTES = 8 << 20

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids (unsigned 32-bit little-endian, end id included).

    Files are memory-mapped where their file system is local; a task holds a few MB of ids at a time. There is a task for
    each file, up to READ_TASKS.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(row["file"], row["base"])

    files = manifest.select("file", "base")
    return files.repartition(min(READ_TASKS, max(1, files.count()))).mapInArrow(read, TOKENS)


def _read_file(file: str, base: int) -> Iterator[pa.RecordBatch]:
    with storage.open_random(f"{file}.idx") as source:
        index = np.frombuffer(source.read(), "<i8")
    docs, width = int(index[0]), int(index[1])
    offsets, ids = index[2 : docs + 3], index[docs + 3 : 2 * docs + 3]
    with storage.open_random(f"{file}.bin") as source:
        first = 0
        while first < docs:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_BYTES // 4, "right")) - 1)
            a, b = int(offsets[first]), int(offsets[last])
            source.seek(a * width)
            tokens = np.frombuffer(source.read((b - a) * width), f"<u{width}").astype("<u4")
            cuts = (offsets[first : last + 1] - a).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first:last], mask=ids[first:last] == _NULL_ID),
                    pa.array(offsets[first:last] + base),
                    pa.array([tokens[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ],
                names=["doc_id", "start", "ids"],
            )
            first = last
