"""Substring dedup with fixed-block anchors (operator 7).

A repeat of ``WINDOW`` words always holds, whole, one of the non-overlapping
blocks of ``WINDOW // 2`` words that a reference document is cut into. So the
blocks of all documents are indexed, every rolling window of block length
probes them, and around each hit the repeat is extended to its maximal length
by comparing the ``WINDOW``-word windows that cover the anchor; a run of equal
windows is the maximal exact repeat. A word goes if such a window's words also
start in a document with a smaller id.

Rows are packed into chunks of a megabyte or so, stored once in a table
bucketed by the task that wrote them, so that texts never move again: what the
buckets answer joins them where they lie. Hashes travel packed, a row per chunk
and hash bucket that the chunk has values for, each value once a chunk, so a
passage that stands everywhere is as cheap as any other and there are never
more rows than values, however many buckets there are. The probe sends
32 + log2(buckets) hash bits (a false hit only costs a comparison); the
extension compares 128 bits: two polynomials over two independent XXH64 hashes
of each word. Buckets grow with the input, so a task's share does not.

Defined results: NULL or blank text has no words. Rows that share an id don't
remove each other's words. A NULL id counts as larger than any other. Texts of
fewer words than a window stay as they are. Ids must be whole numbers. A text
is never cut, so the longest one must fit a Python worker (about 150 bytes of
memory a word).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.util import col, read_documents, store
from prepforge.llm.words import Words, in_one_row, row_slices, space_table, split_words, window_hashes, word_hashes
from prepforge.session import ensure_checkpoint_dir

WINDOW = 50
#: Bytes of text in a chunk, and (about) of text behind a hash bucket.
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 128

_LAST = np.int64((1 << 63) - 1)
_SECOND = 0xA0761D6478BD642F


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in row_slices(b.column("text"), size):
            ends = pa.array([0, hi - lo], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, b.column(c).slice(lo, hi - lo)) for c in ("doc_id", "text")], ["ids", "texts"])


class _Chunk:
    """A chunk's words and hashes."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        self.texts, self.ids = texts, ids.fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
        self.words: Words = split_words(texts, space_table())
        self.first = self.words.first
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.h = word_hashes(self.words)

    def windows(self, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of k words, in rows of ``least`` words and more."""
        v = window_hashes(self.h, k)
        at = np.flatnonzero(in_one_row(self.first, k) & (self.n >= least)[self.row[:len(v)]])
        return at, v[at]

    def second(self, k: int) -> np.ndarray:
        """Independent hashes of all windows of k words."""
        return window_hashes(word_hashes(self.words, 1), k, _SECOND)


def _dealt(v: np.ndarray, bits: int, has: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (top bits) that sorted hashes fall into, or ``has``, and
    their limits; values of other buckets than ``has`` don't occur."""
    bucket = (v >> np.uint64(64 - bits)).astype(np.int64)
    has = np.unique(bucket) if has is None else has
    return has, np.concatenate([[0], np.searchsorted(bucket, has, "right")]).astype(np.int32)


def _lists(limits: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), flat)


def _low(v: np.ndarray, bits: int) -> pa.Array:
    """The 32 bits below the bucket's."""
    return pa.array(((v >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, _Chunk, pa.Scalar | None]]:
    for b in batches:
        hits = b.column("hits") if "hits" in b.schema.names else None
        for i in range(b.num_rows):
            yield (b.column("part")[i].as_py(), b.column("chunk")[i].as_py(), _Chunk(b.column("ids")[i].values, b.column("texts")[i].values),
                   hits[i].values if hits is not None and hits[i].is_valid else None)


def _named(part: int, chunk: int, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, chunk), pa.int64())]


def _probe(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket: its rolling windows' values, those found in more
    than one of its rows, and its own blocks' values."""
    size = window // 2
    for part, chunk, c, _ in _chunk_rows(batches):
        at, v = c.windows(size, window)
        row = c.row[at]
        blocks = np.unique(v[(at - c.first[row]) % size == 0])
        order = np.argsort(v, kind="stable")
        v, row = v[order], row[order]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:], [len(v)]])[:len(head)] - 1
        several = v[head[row[head] != row[tail]]]
        v = v[head]
        has, cuts = _dealt(v, bits)
        lists = [_lists(cuts, _low(v, bits)), *(_lists(_dealt(x, bits, has)[1], _low(x, bits)) for x in (several, blocks))]
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), *_named(part, chunk, len(has)), *lists], ["bucket", "part", "chunk", "probes", "several", "blocks"])


def _by_bucket(batches: Iterator[pa.RecordBatch], work: Callable[[int, pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each bucket; they come sorted by bucket."""
    kept: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        k = b.column("bucket").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if kept and k[lo] != now:
                yield work(int(now), pa.Table.from_batches(kept))
                kept = []
            kept.append(b.slice(lo, hi - lo))
            now = k[lo]
    if kept:
        yield work(int(now), pa.Table.from_batches(kept))


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    x = t.column(name).combine_chunks()
    n = np.diff(x.offsets.to_numpy())
    return x.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)


def _member(v: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, -1 where it is absent."""
    if not len(among):
        return np.full(len(v), -1)
    at = np.minimum(np.searchsorted(among, v), len(among) - 1)
    return np.where(among[at] == v, at, -1)


def _answer(t: pa.Table, row: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The values (ordered by row) as lists, one for each row that has any."""
    rows, n = np.unique(row, return_counts=True)
    limits = np.concatenate([[0], np.cumsum(n)])
    return pa.RecordBatch.from_arrays([t.column(k).combine_chunks().take(pa.array(rows)) for k in ("part", "chunk")]
                                      + [_lists(limits, pa.array(x)) for x in cols.values()], ["part", "chunk", *cols])


def _anchors(bucket: int, t: pa.Table) -> pa.RecordBatch:
    """Indexed values that more than one row has, told to the chunks that have them."""
    blocks = np.unique(_flat(t, "blocks")[0].view(np.uint32))
    v, row = _flat(t, "probes")
    place = _member(v.view(np.uint32), blocks)
    on = place >= 0
    v, row, place = v.view(np.uint32)[on], row[on], place[on]
    seen = np.bincount(place, minlength=len(blocks))
    several = _member(_flat(t, "several")[0].view(np.uint32), blocks)
    seen[several[several >= 0]] += 1
    on = seen[place] > 1
    return _answer(t, row[on], {"hits": (np.int64(bucket) << 32) + v[on].astype(np.int64)})


def _extend(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The windows that cover an anchor: two hashes and the smallest id that
    has them in the chunk (and the largest, if it is another)."""
    size = window // 2
    for part, chunk, c, hits in _chunk_rows(batches):
        if hits is None:
            continue
        at, v = c.windows(size, window)
        anchor = at[_member((v >> np.uint64(32 - bits)).astype(np.int64), np.unique(hits.to_numpy())) >= 0]
        s, h1 = c.windows(window, window)
        near = np.searchsorted(anchor, s + (window - size), "right") > np.searchsorted(anchor, s)
        s, h1 = s[near], h1[near]
        ids = c.ids[c.row[s]]
        h2 = c.second(window)[s] if len(s) else h1
        order = np.lexsort((ids, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        edge = np.concatenate([[True], h1[1:] != h1[:-1], [True]]) if len(h1) else np.ones(1, bool)
        head, tail = edge[:-1], edge[1:]
        last = tail & (ids != ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]) if len(ids) else tail
        keep = head | last
        h1, h2, ids = h1[keep], h2[keep], ids[keep]
        has, cuts = _dealt(h1, bits)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), *_named(part, chunk, len(has)), *(_lists(cuts, pa.array(x)) for x in (h1.view(np.int64), h2.view(np.int64), ids))],
                                         ["bucket", "part", "chunk", "h1", "h2", "ids"])


def _smaller(bucket: int, t: pa.Table) -> pa.RecordBatch:
    """Windows that a smaller id has as well, with that id, told to their chunks."""
    h1, row = _flat(t, "h1")
    h2, ids = _flat(t, "h2")[0], _flat(t, "ids")[0]
    order = np.lexsort((h2, h1))
    new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]) if len(h1) else np.zeros(0, bool)
    group = np.empty(len(h1), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), _LAST)
    np.minimum.at(least, group, ids)
    on = ids > least[group]
    return _answer(t, row[on], {"hits": h1[on], "second": h2[on], "least": least[group][on]})


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Per row: words, removed words, what is left."""
    for b in batches:
        for i, (_, _, c, hits) in enumerate(_chunk_rows([b])):
            gone = np.zeros(len(c.h), bool)
            if hits is not None:
                known, other, low = (b.column(x)[i].values.to_numpy() for x in ("hits", "second", "least"))
                order = np.lexsort((low, known))
                known, other, low = known[order], other[order], low[order]
                s, h1 = c.windows(window, window)
                place = _member(h1.view(np.int64), known)
                s, place = s[place >= 0], place[place >= 0]
                s = s[(c.ids[c.row[s]] > low[place]) & (c.second(window)[s].view(np.int64) == other[place])]
                cover = np.zeros(len(c.h) + 1, np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])
            lens = (c.words.ends - c.words.starts)[~gone] + 1
            ends = np.concatenate([[0], np.cumsum(lens)])
            body = np.full(int(ends[-1]), 32, np.uint8)
            inside = np.ones(len(body), bool)
            inside[ends[1:] - 1] = False
            mark = np.zeros(len(c.words.low) + 1, np.int8)
            mark[c.words.starts[~gone]] = 1
            np.add.at(mark, c.words.ends[~gone], -1)
            body[inside] = c.words.low[np.cumsum(mark[:-1], dtype=np.int8) > 0]
            raw = body.tobytes()
            limits = ends[kept[c.first]]
            texts = [raw[lo:max(lo, hi - 1)] for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
            cols = [b.column("ids")[i].values, pa.array(c.n, pa.int64()), pa.array(c.n - np.diff(kept[c.first]), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True,
                     chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if
    asked for, ``kept_text`` (kept words joined by one space)."""
    spark = docs.sparkSession
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(least_buckets, -(-size // bucket_bytes)).bit_length())
    places = max(4 * rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"substring_chunks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(lambda b: _chunks(b, chunk_bytes), "ids array<long>, texts array<string>")
    named = packed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("chunk"), "ids", "texts")

    def told(answers: DataFrame, *cols: str) -> DataFrame:
        """The chunks with what their windows were answered; only the answers
        move, to the buckets of the tasks whose chunks asked. (Written as a
        difference, the chunk's number is no join key, which would deal the
        texts anew.)"""
        own = lambda c: F.flatten(F.collect_list(c)).alias(c)
        each = answers.repartition(places, "part").groupBy("part", "chunk").agg(*map(own, cols)).withColumnRenamed("chunk", "to")
        return spark.table(table).join(each.withColumnRenamed("part", "of"), F.expr("part = of AND chunk - to = 0"), "left").select("part", "chunk", "ids", "texts", *cols)

    def asked(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    try:
        named.write.bucketBy(places, "part").option("path", os.path.join(ensure_checkpoint_dir(spark), table)).saveAsTable(table)
        probes = asked(spark.table(table).mapInArrow(lambda b: _probe(b, window, bits), "bucket int, part int, chunk long, probes array<int>, several array<int>, blocks array<int>"))
        anchors = store(probes.mapInArrow(lambda b: _by_bucket(b, _anchors), "part int, chunk long, hits array<long>"), "anchors")
        cover = asked(told(anchors, "hits").mapInArrow(lambda b: _extend(b, window, bits), "bucket int, part int, chunk long, h1 array<long>, h2 array<long>, ids array<long>"))
        repeats = store(cover.mapInArrow(lambda b: _by_bucket(b, _smaller), "part int, chunk long, hits array<long>, second array<long>, least array<long>"), "repeats")
        kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        return store(told(repeats, "hits", "second", "least").mapInArrow(lambda b: _cut(b, window, with_text), kind), "substrings")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_documents(spark, sf_dir), with_text=False)


#: Every window of every text, and the smallest id that has it.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
m AS (SELECT r, doc_id, i, word, md5(string_agg(word, ' ') OVER u) AS t, count(*) OVER u = {WINDOW} AS whole FROM x
      WINDOW u AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
l AS (SELECT t, min(doc_id) AS least FROM m WHERE whole GROUP BY t),
b AS (SELECT r, i, word, whole AND least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) AS later FROM m LEFT JOIN l USING (t)),
g AS (SELECT r, i, word, bool_or(later) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM b),
k AS (SELECT r, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
