"""Benchmark decontamination with a positional inverted index (operator 4).

``build_index`` stores the postings of all training words, sharded by
document: a shard holds some MB of consecutive rows, and for each term (a
64-bit hash of the lower-cased word) the sorted positions at which it stands.
``search`` takes the benchmark in blocks of bounded size. For each window of
``WINDOW`` item words it starts from the postings of the window's rarest term
(by frequency over the whole corpus) and intersects them with those of the
other terms, rarest first, each list shifted by the term's offset. What is
left are exact phrase matches. Proximity matches are items whose
``NEAR_TERMS`` rarest terms all stand within ``NEAR_WORDS`` words of the
rarest one, in any order (terms equally rare: in the order of their bytes).

Neither step shuffles postings: a document's lists are all in its shard. Only
term frequencies of the benchmark's words and the matches leave the shards.

Defined results: NULL text has no words; an item of fewer words than a window
is one window, one without words is never matched; a NULL ``item_id`` hits
words but is not listed; items sharing an id count once. Repeated documents
are searched one by one. An empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.llm.util import col, fresh, read_documents, store
from prepforge.llm.words import alnum_table, in_one_row, ranges, row_slices, split_words, word_hashes

WINDOW = 10
NEAR_TERMS = 3
NEAR_WORDS = 20
#: Bytes of benchmark text searched at once. A task gets about 60 bytes for each
#: of its words, some ten times the text.
BLOCK_BYTES = 4 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 4 << 20
#: Unused positions between the rows of a shard: no window or neighbourhood spans them.
GAP = 64

_TERM = np.uint64(40)  # bits of a position in a posting's sort key


def _lists(flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row holding the whole array."""
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, kind))


def _index_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in row_slices(b.column("text"), shard_bytes):
            part = b.slice(lo, hi - lo)
            w = split_words(part.column("text"), alnum_table())
            terms, codes = np.unique(word_hashes(w), return_inverse=True)
            n = np.diff(w.first)
            place = np.arange(len(codes)) + GAP * np.repeat(np.arange(len(n)), n)
            order = np.argsort(codes, kind="stable")
            at = place[order]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), part.column(c)) for c in ("doc_id", "mark")]
                + [_lists(n, pa.int32()), _lists(terms.view(np.int64), pa.int64()), _lists(np.bincount(codes, minlength=len(terms)), pa.int32()),
                   _lists(np.diff(at, prepend=0), pa.int32())],
                ["doc_id", "mark", "n_words", "terms", "freqs", "steps"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index, a row per shard: ids, text marks and word counts of
    its rows; its terms, their frequencies and the steps between successive
    positions of all lists, one list after another. A shard is a row group of
    its own, so tasks write and read one at a time, however many a file has."""
    kind = T.StructType([T.StructField("doc_id", T.ArrayType(docs.schema[doc_id].dataType)), T.StructField("mark", T.ArrayType(T.LongType())),
                         T.StructField("n_words", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.LongType())),
                         T.StructField("freqs", T.ArrayType(T.IntegerType())), T.StructField("steps", T.ArrayType(T.IntegerType()))])
    rows = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text), F.lit("row")).alias("mark"), col(text).alias("text"))
    shards = rows.mapInArrow(lambda b: _index_shards(b, shard_bytes), kind)
    return store(shards.withColumn("shard", F.monotonically_increasing_id()), "postings", compression="zstd", group_rows=1)


class Windows(NamedTuple):
    """Distinct windows of one length: codes of their words, and the items of
    window x: ``items[limits[x]:limits[x + 1]]``."""

    codes: np.ndarray
    limits: np.ndarray
    items: np.ndarray


class Queries(NamedTuple):
    """A block of the benchmark: distinct terms and their places in byte order;
    windows by their number of words, as codes into ``terms``; ids of the
    items; (item, code) of all words that an item has, each once."""

    terms: np.ndarray
    places: np.ndarray
    windows: list[Windows]
    items: list[str | None]
    words: tuple[np.ndarray, np.ndarray]


def parse_items(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Queries:
    texts = pa.array([t for _, t in rows], pa.string())
    w = split_words(texts, alnum_table())
    terms, at, codes = np.unique(word_hashes(w), return_index=True, return_inverse=True)
    codes = codes.astype(np.int32)
    names = [w.low[s:e].tobytes() for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
    places = np.argsort(np.array(sorted(range(len(names)), key=names.__getitem__), np.int64))
    n = np.diff(w.first)
    item = np.repeat(np.arange(len(n)), n)
    found = []
    for k in range(1, window + 1):
        whole = np.flatnonzero(in_one_row(w.first, k))
        starts = whole[n[item[whole]] >= k] if k == window else w.first[:-1][n == k]
        if len(starts):
            different, which = np.unique(codes[starts[:, None] + np.arange(k)], axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(n) + item[starts])
            found.append(Windows(different, np.searchsorted(pairs, np.arange(len(different) + 1) * len(n)), (pairs % len(n)).astype(np.int32)))
    own = np.unique(item.astype(np.int64) * max(len(terms), 1) + codes)
    return Queries(terms, places, found, [i for i, _ in rows], (own // max(len(terms), 1), own % max(len(terms), 1)))


class Search(NamedTuple):
    """What a task gets of a block, ordered by rarity once: the windows' codes,
    rarest first, with their offsets; the items' rarest terms."""

    terms: np.ndarray
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    items: list[str | None]
    rare: np.ndarray
    rare_items: np.ndarray


def by_rarity(q: Queries, freq: np.ndarray, near_terms: int = NEAR_TERMS) -> Search:
    rank = np.argsort(np.lexsort((q.places, freq)), kind="stable").astype(np.int32)
    windows = []
    for x in q.windows:
        order = np.argsort(rank[x.codes], axis=1, kind="stable").astype(np.int8)
        windows.append((np.take_along_axis(x.codes, order.astype(np.int64), axis=1), order, x.limits, x.items))
    item, code = q.words
    by = np.lexsort((rank[code], item))
    item, code = item[by], code[by]
    head = np.searchsorted(item, np.arange(len(q.items)))
    full = np.flatnonzero(np.diff(np.concatenate([head, [len(item)]])) >= near_terms)
    return Search(q.terms, windows, q.items, code[head[full][:, None] + np.arange(near_terms)].astype(np.int32), full)


def phrase_matches(keys: np.ndarray, codes: np.ndarray, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact occurrences. ``keys`` are the sorted
    postings ``term << 40 | position``; ``codes`` gives the shard's term of a
    query term (-1: absent); ``windows`` come rarest term first, ``order``
    has the terms' offsets."""
    usable = np.arange(len(windows))
    for r in range(windows.shape[1]):  # a window goes with its first absent term
        usable = usable[codes[windows[usable, r]] >= 0]
    order, local = order[usable].astype(np.int64), codes[windows[usable]] << np.int64(_TERM)
    lo = np.searchsorted(keys, local[:, 0])
    n = np.searchsorted(keys, local[:, 0] + (np.int64(1) << np.int64(_TERM))) - lo
    which = np.repeat(np.arange(len(usable)), n)
    start = (keys[ranges(lo, n)] - local[which, 0]) - order[which, 0]
    for r in range(1, windows.shape[1]):
        want = local[which, r] + start + order[which, r]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        on = keys[at] == want if len(keys) else np.zeros(0, bool)
        which, start = which[on], start[on]
    return usable[which], start


def near_matches(keys: np.ndarray, local: np.ndarray, words: int) -> np.ndarray:
    """Positions of the shard's term ``local[0]`` that have all others within ``words``."""
    local = local << np.int64(_TERM)
    lo, hi = np.searchsorted(keys, [local[0], local[0] + (np.int64(1) << np.int64(_TERM))])
    at = keys[lo:hi] - local[0]
    for t in local[1:]:
        a = np.searchsorted(keys, t + np.maximum(at - words, 0))
        at = at[np.searchsorted(keys, t + at + words, "right") > a]
    return at


def _search_shards(batches: Iterator[pa.RecordBatch], q: Search, near_words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shard, words, terms, freqs, steps = (b.column(c) for c in ("shard", "n_words", "terms", "freqs", "steps"))
        out: list[tuple] = []
        for i in range(b.num_rows):
            n, have, count = (x[i].values.to_numpy() for x in (words, terms, freqs))
            keys = (np.repeat(np.arange(len(have)), count) << np.int64(_TERM)) + np.cumsum(steps[i].values.to_numpy(), dtype=np.int64)
            have = have.view(np.uint64)
            at = np.minimum(np.searchsorted(have, q.terms), max(len(have) - 1, 0))
            codes = np.where(have[at] == q.terms, at, -1) if len(have) else np.full(len(q.terms), -1)
            base = np.concatenate([[0], np.cumsum(n[:-1])]) + GAP * np.arange(len(n))
            found: dict[int, tuple[set, set, set]] = {}
            for windows, order, limits, items in q.windows:
                which, start = phrase_matches(keys, codes, windows, order)
                row = np.searchsorted(base, start, "right") - 1
                for r, s, x in zip(row.tolist(), (start - base[row]).tolist(), which.tolist(), strict=True):
                    spans, exact, _ = found.setdefault(r, (set(), set(), set()))
                    spans.add((s, s + windows.shape[1]))
                    exact.update(items[limits[x]:limits[x + 1]].tolist())
            local = codes[q.rare]
            for x in np.flatnonzero((local >= 0).all(axis=1)).tolist():  # all its rarest terms are here
                for r in np.unique(np.searchsorted(base, near_matches(keys, local[x], near_words), "right") - 1).tolist():
                    found.setdefault(r, (set(), set(), set()))[2].add(int(q.rare_items[x]))
            out += [(shard[i].as_py(), r, [{"s": s, "e": e} for s, e in sorted(spans)],
                     *([q.items[x] for x in sorted(y) if q.items[x] is not None] for y in (exact, near))) for r, (spans, exact, near) in found.items()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "row", "spans", "items", "near"])


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES, near_terms: int = NEAR_TERMS, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row per indexed row: ``doc_id``, ``mark``, ``n_words``, ``spans``
    (word limits of exact phrase matches), ``items`` and ``near`` (ids of the
    items with exact and with proximity matches, sorted). The benchmark comes
    to the driver in blocks of about ``block_bytes``; a block's matches are
    stored before the next one is fetched."""
    spark = index.sparkSession
    own = benchmark.select(col(item_id).cast("string").alias("i"), col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    blocks = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    found = None
    for k in range(blocks):
        q = parse_items([tuple(r) for r in own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()], window)
        if not q.windows:
            continue
        ask = spark.createDataFrame(pa.table({"term": q.terms.view(np.int64)}))
        have = index.select(F.explode(F.arrays_zip("terms", "freqs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.freqs").alias("n"))
        total = have.join(F.broadcast(ask), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        freq = np.zeros(len(q.terms), np.int64)
        freq[np.searchsorted(q.terms, total.column("term").to_numpy().view(np.uint64))] = total.column("n").to_numpy()
        sent = spark.sparkContext.broadcast(by_rarity(q, freq, near_terms))
        hits = index.select("shard", "n_words", "terms", "freqs", "steps").mapInArrow(
            lambda b, sent=sent: _search_shards(b, sent.value, near_words),
            "shard long, row int, spans array<struct<s:int,e:int>>, items array<string>, near array<string>")
        hits = hits if blocks == 1 else store(hits, "matches")
        found = hits if found is None else found.unionAll(hits)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "mark", "n_words")).alias("row", "d")).select("shard", "row", "d.*")
    if found is None:
        found = spark.createDataFrame([], "shard long, row int, spans array<struct<s:int,e:int>>, items array<string>, near array<string>")
    if blocks > 1:
        found = found.groupBy("shard", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    return rows.join(found, ["shard", "row"], "left").select(
        "doc_id", "mark", "n_words", F.coalesce("spans", F.array()).alias("spans"),
        *[F.array_sort(F.array_distinct(F.coalesce(c, F.array()))).alias(c) for c in ("items", "near")])


def hit_words() -> F.Column:
    """How many words the (overlapping) spans cover."""
    return F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"] - 1))))).cast("long")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(read_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
                        F.size("near").cast("long").alias("n_near"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with an exact phrase match go. A row is told
    by its id and its text's mark (rows equal in both share the decision)."""
    found = search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = fresh(docs, "key")
    bad = store(found.where(F.size("spans") > 0).select(F.struct("doc_id", "mark").alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, F.struct(col("doc_id").alias("doc_id"), F.xxhash64(col("text"), F.lit("row")).alias("mark")))
    return keyed.join(bad, keyed[key].eqNullSafe(bad[key]), "left_anti").select(*[col(c) for c in docs.columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Word strings of all lengths that windows have, joined with the windows.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
b AS (SELECT row_number() OVER () AS q, item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT q, item, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS t FROM s),
m AS (SELECT r, n, i, string_agg(word, ' ') OVER u AS t, count(*) OVER u AS got FROM x, (SELECT DISTINCT n FROM g)
      WINDOW u AS (PARTITION BY r, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
h AS (SELECT m.r, m.n, m.i, g.item FROM m JOIN g ON m.n = g.n AND m.t = g.t WHERE m.got = m.n),
o AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
f AS (SELECT word, count(*) AS n FROM x GROUP BY word),
k AS (SELECT q, item, word, row_number() OVER (PARTITION BY q ORDER BY coalesce(f.n, 0), word) AS k
      FROM (SELECT DISTINCT q, item, unnest(w) AS word FROM b) LEFT JOIN f USING (word)),
z AS (SELECT q, item, max(word) FILTER (k = 1) AS t0, max(word) FILTER (k = 2) AS t1, max(word) FILTER (k = 3) AS t2 FROM k GROUP BY q, item HAVING count(*) >= {NEAR_TERMS}),
y AS (SELECT DISTINCT a.r, z.item FROM z JOIN x a ON a.word = z.t0 JOIN x b ON b.r = a.r AND b.word = z.t1 AND abs(b.i - a.i) <= {NEAR_WORDS}
      JOIN x c ON c.r = a.r AND c.word = z.t2 AND abs(c.i - a.i) <= {NEAR_WORDS}),
e AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r),
v AS (SELECT r, count(DISTINCT item) AS n_near FROM y GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN o USING (r) LEFT JOIN e USING (r) LEFT JOIN v USING (r)
"""
