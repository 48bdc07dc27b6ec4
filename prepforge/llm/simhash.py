"""SimHash near-duplicates by bit-sliced comparison (operator 8).

Fingerprints: XXH64 of every word shingle, bit-wise majority over the shingles
(repeats included). Rows with equal fingerprints become one node. Nodes that
could be within the radius share one of ``radius + 1`` bit blocks (pigeonhole),
so nodes meet in buckets by block. A bucket's fingerprints are stored as 64
bit planes, 64 fingerprints per machine word; a query's distances to 64 others
are counted together by carry-save counters, plane after plane, and words all
of whose lanes exceed the radius are abandoned.

Large buckets lose nothing: one above ``BUCKET`` nodes is dealt out again by
blocks of the bits outside its own block (again a pigeonhole), and what is
still too large is compared tile by tile. A bucket returns a spanning forest
of its links, and the components of those are the components of all links.

Defined results: no words (NULL, empty, blank): fingerprint zero, linked like
any other. Fewer words than a shingle: the whole sequence. Repeated rows are
kept, each with its component. ``component_id`` is the smallest non-NULL
``doc_id`` reachable (NULL if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.components import connected_components
from prepforge.llm.util import col, fresh, read_documents, store
from prepforge.llm.words import Words, ranges, row_slices, space_lower_table, space_table, split_words
from prepforge.llm.xxh import xxh64

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most nodes compared as one bucket.
BUCKET = 2048


# ---------------------------------------------------------------- fingerprints

def bit_majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row (hashes ``first[i]:first[i+1]``) the bits set in over half its
    hashes; zero for a row without any. Counts are kept in byte lanes, eight
    bits of the hash at a time, in runs of at most 255 hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    runs = -(-n[rows] // 255)
    head = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(first[:-1][rows], runs) + 255 * ranges(np.zeros(len(rows), np.int64), runs)
    got = np.zeros(len(rows), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        major = (2 * counts > n[rows][:, None]).astype(np.uint8)
        got |= np.ascontiguousarray(major).view(np.uint64).reshape(-1) << np.uint64(b)
    out[rows] = got
    return out


def joined_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each word begins."""
    lens = w.ends - w.starts
    begin = np.concatenate([[0], np.cumsum(lens + 1)]).astype(np.int64)
    out = np.full(int(begin[-1]), 32, np.uint8)
    body = np.ones(len(out), bool)
    body[begin[1:] - 1] = False
    out[body] = w.low[space_table()[0][w.low]]
    return out, begin


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    w = split_words(texts, space_lower_table())
    body, begin = joined_words(w)
    n = np.diff(w.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    head = ranges(w.first[:-1], count)
    last = np.minimum(head + shingle, np.repeat(w.first[1:], count))
    h = xxh64(body, begin[head], begin[last] - 1 - begin[head], seed)
    return bit_majority(h, np.concatenate([[0], np.cumsum(count)]))


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [text_fingerprints(b.slice(lo, hi - lo), shingle, seed) for lo, hi in row_slices(b)]
            yield pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return simhash(text)


# ---------------------------------------------------------------- comparison

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64 lanes) fingerprints -> (64 planes, blocks) words."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 64, 8), axis=2, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    return planes.view(np.uint64).reshape(64, len(fps))


def near_lanes(planes: np.ndarray, over: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of ``block[i]`` within ``radius`` of ``query[i]``, as (i, word of
    lanes). ``over`` has the lanes that don't count."""
    width = (radius + 1).bit_length()
    c = [np.zeros(len(query), np.uint64) for _ in range(width)]
    ids, full = np.arange(len(query)), np.uint64((1 << 64) - 1)
    for b in range(64):
        carry = planes[b][block] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            c[k], carry = c[k] ^ carry, c[k] & carry
        hit = np.full(len(query), full)
        for k in range(width):  # counts rise one by one: radius + 1 is never jumped over
            hit &= c[k] if (radius + 1) >> k & 1 else ~c[k]
        over = over | hit
        if b % 8 == 7:
            live = np.flatnonzero(over != full)
            if 2 * len(live) < len(over):
                ids, over, query, block, c = ids[live], over[live], query[live], block[live], [x[live] for x in c]
    live = np.flatnonzero(over != full)
    return ids[live], ~over[live]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, of the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
        on = label[a] != label[b]
        a, b = a[on], b[on]
    return label


def bucket_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each bucket; ``group`` has equal entries together."""
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([head, [len(group)]]))
    blocks = -(-size // 64)
    block0 = np.concatenate([[0], np.cumsum(blocks)])
    of = np.repeat(np.arange(len(head)), size)
    rank = np.arange(len(fps)) - head[of]
    slots = np.zeros((int(block0[-1]), 64), np.uint64)
    valid = np.zeros((len(slots), 64), np.uint8)
    slots[block0[of] + rank // 64, rank % 64] = fps
    valid[block0[of] + rank // 64, rank % 64] = 1
    planes = bit_planes(slots)
    absent = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    # a query meets its own block and the later ones of its bucket
    later = blocks[of] - rank // 64
    q = np.repeat(np.arange(len(fps)), later)
    block = ranges(block0[of] + rank // 64, later)
    own = block == (block0[of] + rank // 64)[q]
    over = absent[block] | np.where(own, np.uint64(1) << (rank[q] % 64).astype(np.uint64), np.uint64(0))
    i, lanes = near_lanes(planes, over, fps[q], block, radius)
    if not len(i):
        return fps[:0], fps[:0]
    hit, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    a = q[i[hit]]
    b = head[of[a]] + (block[i[hit]] - block0[of[a]]) * 64 + lane
    label = forest(len(fps), a, b)
    on = label != np.arange(len(fps))
    return fps[on], fps[label[on]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Buckets come one after another, sorted; those that may go on in the next batch wait."""
    kept: tuple = ()

    def rows(t: pa.RecordBatch) -> tuple:
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("key", "i", "j")])
        return key, t.column("fp").to_numpy().view(np.uint64)

    def work(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(fps) else np.zeros(0, bool)
        u, v = bucket_links(np.cumsum(new), fps, radius) if len(fps) else (fps, fps)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for t in batches:
        for lo in range(0, t.num_rows, step):
            key, fps = rows(t.slice(lo, step))
            if kept:
                key, fps = np.concatenate([kept[0], key], axis=1), np.concatenate([kept[1], fps])
            same = (key == key[:, -1:]).all(axis=0)
            cut = len(fps) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield work(key[:, :cut], fps[:cut])
            kept = key[:, cut:], fps[cut:]
    if kept:
        yield work(*kept)


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``parts`` near-equal blocks of ``width`` bits."""
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _bits(x: Column, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1))


def _buckets(nodes: DataFrame, radius: int, most: int) -> DataFrame:
    """(key, i, j, fp): in which buckets each node is compared. ``key`` packs
    block number and value, and those of the second blocks (31: none)."""
    fp = F.col("fp")
    first = _blocks(64, radius + 1)

    def pack(t: int, v: Column, t2: int = 31, v2: Column | None = None) -> Column:
        low = F.lit(t << 5 | t2).cast("long")
        return F.shiftleft(F.shiftleft(v, 20).bitwiseOR(F.lit(0) if v2 is None else v2), 10).bitwiseOR(low)

    def sized(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        n = store(df.groupBy("key").count().where(F.col("count") > most), "simhash-large")
        return n, None if n.isEmpty() else df.join(n, "key")

    keyed = nodes.select("fp", F.explode(F.array(*[pack(t, _bits(fp, s, n)) for t, (s, n) in enumerate(first)])).alias("key"))
    tile = [F.lit(0).alias("i"), F.lit(0).alias("j"), "fp"]
    large, rest = sized(keyed)
    if rest is None:
        return keyed.select("key", *tile)
    out = keyed.join(large, "key", "left_anti").select("key", *tile)
    again = []
    for t, (s, n) in enumerate(first):  # the bits outside block t, as one number of 64 - n bits
        other = _bits(fp, 0, s).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, s + n), s) if s + n < 64 else F.lit(0).cast("long"))
        again.append(F.when(F.col("key").bitwiseAND(F.lit(1023)) == (t << 5 | 31),
                            F.array(*[pack(t, _bits(fp, s, n), t2, _bits(other, s2, n2)) for t2, (s2, n2) in enumerate(_blocks(64 - n, radius + 1))])))
    second = store(rest.select("fp", F.explode(F.coalesce(*again)).alias("key")), "simhash-second")
    large, rest = sized(second)
    if rest is None:
        return out.unionAll(second.select("key", *tile))
    out = out.unionAll(second.join(large, "key", "left_anti").select("key", *tile))
    parts = F.ceil(F.col("count") * 2 / most)
    own = F.pmod(F.xxhash64("fp", F.lit("tile")), parts)
    tiles = rest.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    return out.unionAll(tiles.select("key", F.least("own", "other").cast("int"), F.greatest("own", "other").cast("int"), "fp"))


def link_components(rows: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (doc_id, fp, ...) plus ``component_id``."""
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    cells = _buckets(nodes.select("fp"), radius, bucket).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    stars = connected_components(cells.mapInArrow(lambda b: _compare(b, radius), "u long, v long"))
    placed = nodes.join(stars, nodes["fp"] == stars["u"], "left").select("fp", "low", F.coalesce("v", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(placed.join(least, "root").select("fp", "component_id"), "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    rows = store(docs.select("doc_id", fingerprint(col("text")).alias("fp")), "simhash-rows")
    return link_components(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row with the
    smallest ``doc_id`` stays (NULL last; ties: smallest text hash, then any
    one of equal rows)."""
    mark = F.xxhash64(col("text"), F.lit("row"))
    rows = store(docs.select(col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), fingerprint(col("text")).alias("fp")), "dedup-rows")
    # by fingerprint as the component's name: documents may share or lack ids
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    named = link_components(rows.select("fp").distinct().select(F.col("fp").alias("doc_id"), "fp")).select("fp", F.col("component_id").alias("name"))
    stay = nodes.join(named, "fp").groupBy("name").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark")
    key, row = fresh(docs, "key"), fresh(docs, "row")
    whole = docs.select(F.struct(col("doc_id").cast("long").alias("doc_id"), mark.alias("mark")).alias(key), F.struct(*[col(c) for c in docs.columns]).alias(row))
    once = whole.groupBy(key).agg(F.first(row).alias(row))
    won = stay.select(F.struct("doc_id", "mark").alias(key))
    return once.join(won, once[key].eqNullSafe(won[key]), "left_semi").select(*[F.col(row)[c].alias(c) for c in docs.columns])
