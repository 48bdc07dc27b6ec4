"""Token-id files with fixed-width bit packing (operator 12).

``write_tokens`` encodes whole texts with a public tokenizer, puts the
documents in ascending ``doc_id`` order by a range shuffle of their ids (texts
never move) and writes one file per range into a shared folder, with a
manifest that Spark commits. ``TokenFile`` opens such a file for random access;
``read_tokens`` reads all of them back in parallel.

A file holds, one after another::

    magic             8 bytes
    blocks            BLOCK_IDS ids each (the last: what is left), every id in
                      the least number of bits that the vocabulary needs, lowest
                      bit first, the block filled up to whole bytes
    documents         Arrow stream: doc_id, start (ids of the file before it)
    block offsets     Arrow stream: offset of each block
    tail              places of the two streams, number of ids (3 x u64), bits
                      and BLOCK_IDS (2 x u32), magic

Ids are unpacked for a whole range of blocks at once: an id's bits lie within
the eight bytes that begin at its first bit's byte, so one gather, shift and
mask gives all of them.

A task writes under a name of its own and returns it; the manifest names only
files of tasks that ended well, so a lost executor or a second attempt leaves
at most an unlisted file.

Defined results: a NULL text is empty (its end id only). A NULL ``doc_id``
comes last. Rows that share an id stay separate rows, ordered by a hash of
their ids (equal rows can't be told apart). An empty table has no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepforge.llm.util import col, read_documents, store
from prepforge.llm.words import Words, alnum_table, ranges, row_slices, space_table, split_words
from prepforge.session import ensure_checkpoint_dir

END_ID = 2
BLOCK_IDS = 8192
#: About so many bytes of encoded ids in a file; texts encoded at once; ids read at once.
FILE_BYTES = 64 << 20
SLICE_BYTES = 8 << 20
READ_IDS = 1 << 20
#: Words whose ids a task remembers (some 200 bytes each) before it starts anew; texts in one call of the library (bounds its working memory).
KNOWN_PIECES = 400_000
CALL_TEXTS = 1024

MAGIC = b"TOKBITS1"
_TAIL = "<3Q2I8s"


# ------------------------------------------------------------------- packing

def width(vocabulary: int) -> int:
    """Least bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    body = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))
    at = np.arange(n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The shared folder's file system (local path or URI) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _stream(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


class TokenWriter:
    """Writes one file; ids are held for one block only."""

    def __init__(self, path: str, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        system, self.path = filesystem(path)
        system.create_dir(os.path.dirname(self.path), recursive=True)
        self.bits, self.block_ids, self.n, self.at = width(vocabulary), block_ids, 0, len(MAGIC)
        self.left, self.offsets, self.docs = np.zeros(0, np.uint32), [], []
        self.out = system.open_output_stream(self.path)
        self.out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Some documents: their ids one after another, ``counts`` of each."""
        starts = self.n + np.cumsum(counts) - counts
        self.docs.append(pa.table({"doc_id": doc_ids, "start": pa.array(starts, pa.int64())}))
        self.n += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // self.block_ids * self.block_ids
        for lo in range(0, whole, self.block_ids):
            self._block(ids[lo:lo + self.block_ids])
        self.left = ids[whole:]

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        parts = [_stream(pa.concat_tables(self.docs)), _stream(pa.table({"offset": pa.array(self.offsets, pa.int64())}))]
        for p in parts:
            self.out.write(p)
        self.out.write(struct.pack(_TAIL, self.at, self.at + len(parts[0]), self.n, self.bits, self.block_ids, MAGIC))
        self.out.close()


class TokenFile:
    """Random access to one file: ``ids(lo, hi)`` reads only the blocks of that
    range, ``document(i)`` only those of the i-th document."""

    def __init__(self, path: str) -> None:
        system, inner = filesystem(path)
        self.file = system.open_input_file(inner)
        size = struct.calcsize(_TAIL)
        end = self.file.size() - size
        docs, blocks, self.n, self.bits, self.block_ids, magic = struct.unpack(_TAIL, self.file.read_at(size, end))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        table = pa.ipc.open_stream(self.file.read_at(blocks - docs, docs)).read_all().combine_chunks()
        self.doc_ids = table.column("doc_id")
        self.starts = np.concatenate([table.column("start").to_numpy(), [self.n]])
        self.offsets = np.concatenate([pa.ipc.open_stream(self.file.read_at(end - blocks, blocks)).read_all().column("offset").to_numpy(), [docs]])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, -(-hi // self.block_ids)
        raw = np.frombuffer(self.file.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first])), np.uint8)
        at, size = self.offsets[first:last + 1] - self.offsets[first], self.block_ids * self.bits
        if size % 8 == 0:  # blocks without filling lie like one
            return unpack(raw, min(last * self.block_ids, self.n) - first * self.block_ids, self.bits)[lo - first * self.block_ids:hi - first * self.block_ids]
        each = [unpack(raw[at[b]:at[b + 1]], min(self.block_ids, self.n - (first + b) * self.block_ids), self.bits) for b in range(last - first)]
        return np.concatenate(each)[lo - first * self.block_ids:hi - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


# ------------------------------------------------------------------ encoding

class Encoder:
    """Encodes slices of texts with a tokenizer of the tokenizers library.

    ``by_word`` is for tokenizers that drop white space and join nothing
    across it: each different word (``[^\x20\x09-\x0D]+``) of a slice is
    then encoded once, which gives the whole texts' ids. If it also lower-cases
    and takes runs of letters as pieces, words are compared in lower case and
    without closing punctuation, and a word of letters goes straight to the
    library's model. Which characters are letters, and how they are spelt
    there, is asked of the library: those of which one or two in a row make
    one piece, spelt one by one."""

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.known: dict[str, bytes] = {}
        letters = self._letters() if by_word else {}
        self.spelling = str.maketrans(letters)
        self.plain = re.compile(f"[{''.join(letters)}]+") if "a" in letters and "A" in letters and letters["A"] == letters["a"] == "a" else None

    def _letters(self) -> dict[str, str]:
        out = {}
        for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)]):
            low = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            pieces = [[x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(low * n)] for n in (1, 2)] if self.tokenizer.pre_tokenizer else []
            if len(low) == 1 and low.isalpha() and pieces and len(pieces[0]) == 1 and pieces[1] == [pieces[0][0] * 2]:
                out[c] = pieces[0][0]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), CALL_TEXTS):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo:lo + CALL_TEXTS], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        if self.plain is None:
            return self._whole(words)
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        known, tokenize, plain, spelling = self.known, self.tokenizer.model.tokenize, self.plain.fullmatch, self.spelling
        out: list = [known.get(word) for word in words]
        for i in [i for i, x in enumerate(out) if x is None]:
            word = words[i]
            if (word.isascii() and word.isalpha()) or plain(word):
                out[i] = known[word] = array("I", [t.id for t in tokenize(word.translate(spelling))]).tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _parts(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes of all words, and the limits and first one (per
        row) of their parts: closing punctuation after a letter or digit is a
        part of its own, as it is a piece of its own to the tokenizer."""
        lower, alnum = alnum_table()[1], np.zeros(256, bool)
        low = lower[w.low]
        for i in np.unique(np.searchsorted(w.starts, np.flatnonzero(w.low == 60), "right") - 1).tolist():
            low[w.starts[i]:w.ends[i]] = w.low[w.starts[i]:w.ends[i]]  # may hold a special token, whose case counts
        alnum[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
        closing = np.zeros(256, bool)
        closing[[*b".,;:!?"]] = True
        last = np.maximum.accumulate(np.where(closing[low], -1, np.arange(len(low)))) if len(low) else np.zeros(0, np.int64)
        core = last[w.ends - 1] + 1
        cut = (core > w.starts) & (core < w.ends)
        cut[cut] = alnum[low[core[cut] - 1]]
        at = np.arange(len(cut)) + np.cumsum(cut) - cut
        lens = np.empty(len(cut) + int(cut.sum()), np.int64)
        lens[at] = np.where(cut, core, w.ends) - w.starts
        lens[at[cut] + 1] = (w.ends - core)[cut]
        return low[space_table()[0][low]], lens, w.first + np.concatenate([[0], np.cumsum(cut)])[w.first]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the number of each row."""
        if not self.by_word:
            return _flat(self._whole(texts.fill_null("").to_pylist()))
        w = split_words(texts, space_table())
        if self.plain is None:
            body, lens, first = w.low[space_table()[0][w.low]], w.ends - w.starts, w.first
        else:
            body, lens, first = self._parts(w)
        limits = pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64))
        words = pa.LargeStringArray.from_buffers(len(lens), limits, pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()
        flat, each = _flat(self._words(words.dictionary.to_pylist()))
        at, index = np.cumsum(each) - each, words.indices.to_numpy()
        count = each[index]
        total = np.concatenate([[0], np.cumsum(count)])
        return flat[ranges(at[index], count)], np.diff(total[first])


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(counts + 1) - 1] = False
    out[own] = ids
    return out, counts + 1


def _cell_type(bits: int) -> np.dtype:
    """What an id takes between the tasks that encode and those that write."""
    return np.dtype("<u2" if bits <= 16 else "<u4")


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, by_word: bool, size: int, bits: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import zstandard
    encoder, press = Encoder(path, by_word), zstandard.ZstdCompressor(1)  # what is stored and shuffled before the files
    for b in batches:
        for lo, hi in row_slices(b.column("text"), size):
            ids, counts = _with_end(*encoder.ids(b.column("text").slice(lo, hi - lo)), end_id)
            raw = memoryview(ids.astype(_cell_type(bits)).view(np.uint8))
            at = (np.concatenate([[0], np.cumsum(counts)]) * _cell_type(bits).itemsize).tolist()
            cells = pa.array([press.compress(raw[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(counts), cells], ["doc_id", "n", "ids"])


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    writer, docs = None, 0
    for b in batches:
        if b.num_rows and writer is None:
            name = f"ids-{part:07d}-{uuid.uuid4().hex}.tok"
            writer = TokenWriter(f"{folder}/{name}", vocabulary, block_ids)
        if b.num_rows:
            writer.add(b.column("doc_id"), b.column("n").to_numpy(), _flat_ids(b.column("ids"), writer.bits))
            docs += b.num_rows
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([docs], pa.int64()), "ids": pa.array([writer.n], pa.int64())})


def _flat_ids(cells: pa.Array, bits: int) -> np.ndarray:
    """All ids of a column of encoded rows."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(press.decompress(c) for c in cells.to_pylist()), _cell_type(bits)).astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", by_word: bool = False,
                 block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write all documents' ids to ``folder`` (shared by driver and executors);
    returns the manifest, stored there too: part, file, docs, ids, start (ids
    of all files before it). ``tokenizer`` is a file of the tokenizers library
    that every executor can read."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    if not 0 <= end_id < vocabulary:
        raise ValueError("the end id must be one of the vocabulary")
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids binary"
    # stored: the range shuffle samples its input, which would encode it twice
    encoded = store(rows.mapInArrow(lambda b: _encode_rows(b, tokenizer, end_id, by_word, slice_bytes, width(vocabulary)), kind), "encoded")
    size = (encoded.agg(F.sum("n")).first()[0] or 0) * 4
    parts = max(1, -(-size // file_bytes), min(encoded.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    order = [F.asc_nulls_last("doc_id"), "hash", "row"]  # the last two spread an id that very many rows share
    dealt = encoded.withColumns({"hash": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = dealt.select("doc_id", "n", "ids").mapInArrow(lambda b: _write_files(b, folder, vocabulary, block_ids), "part int, file string, docs long, ids long")
    files.write.parquet(f"{folder}/files")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    spark.read.schema(files.schema).parquet(f"{folder}/files").withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, file string, docs long, ids long, start long").parquet(f"{folder}/manifest")


def _read_rows(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool, read_ids: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, before in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
            f = TokenFile(f"{folder}/{name}")
            lo, docs = 0, len(f.starts) - 1
            while lo < docs:
                hi = max(lo + 1, int(np.searchsorted(f.starts, f.starts[lo] + read_ids, "right")) - 1)
                s = f.starts[lo:hi + 1]
                raw = np.ascontiguousarray(f.ids(int(s[0]), int(s[-1])), "<u4")
                at = (s - s[0]).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
                ids = f.doc_ids.slice(lo, hi - lo).combine_chunks()
                cols = [ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, pa.array(before + s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(raw.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi
            f.close()


def read_tokens(spark: SparkSession, folder: str, doc_id_type: str = "long", with_ids: bool = True, read_ids: int = READ_IDS) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and, if asked for, ids."""
    kind = f"doc_id {doc_id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    each = manifest(spark, folder)
    dealt = each.repartition(max(1, each.count()), "part")
    return dealt.select("file", "start").mapInArrow(lambda b: _read_rows(b, folder, with_ids, read_ids), kind)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_bpe_49k`` lower-cases, drops white space and never joins across
    it, so its words may be encoded alone."""
    import public_tokenizers
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder, by_word=True)
    return read_tokens(spark, folder, with_ids=False)
