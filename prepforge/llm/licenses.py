"""License scans: exact set-similarity join (operator 1), in DataFrame operations.

Texts are cut into overlapping word blocks: one begins every ``stride`` words
and holds ``2 * stride``, where ``stride`` is at least the longest template,
so every run of up to ``stride + 1`` words lies in the block that owns its
first word. A block matches a template if it contains at least the template's
threshold share of its distinct words.

The join is exact and filters before it compares. All words are ordered by
their frequency over the whole corpus, rarest first. A block can only contain
``need`` of a template's words if one of them is in the template's prefix, the
first ``size - need + 1`` words of that order: only blocks holding a prefix
word are made at all, and they join the templates' prefix index on it. The
length filter drops blocks with fewer template words than ``need``, the
positional filter those where the words that follow the shared one, in the
block or in the template, can't make up ``need`` any more. What is left is
compared in full. A statement that has marks, the runs of words that tell its
license from others, must then stand in one window of twice its length with
all of them: the one word that may be missing is not the one that names the
license. The templates are a parameter; their index is broadcast while
it has at most ``BROADCAST_ROWS`` rows and shuffled beyond that.

Base phrases are templates whose threshold is 1; their places are then the
starts, in the blocks found, where the words stand consecutively.

Defined results: NULL or empty text has no words, no labels, score 0. Rows are
told apart by an internal row number, so ids may be NULL or repeat.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.util import col, read_documents

# Base phrases and their labels; license statements known to the method, with labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
STATEMENTS = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
}
CONTAINMENT = 0.8
#: Runs of words that a statement's place must have, by its first words; | parts alternatives.
MARKS = {
    "licensed under the apache": ("apache license", "version 2|license 2|v2"),
    "released under the mit": ("mit", "license|licence"),
    "permission is hereby granted": ("free of charge", "copy of this software"),
    "redistribution and use": ("redistribution", "binary", "permitted"),
    "this work is licensed under the gnu": ("gnu general public license", "version 3|v3"),
    "licensed under cc by nc": ("cc by nc 4",),
    "licensed under a creative commons": ("creative commons", "attribution sharealike|attribution share alike"),
    "this source code form": ("mozilla public license", "source code form"),
}

#: Words of a text in any letter case; they are lower-cased one by one.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_STRIDE = 32
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    name: str
    label: str
    words: list[str]
    threshold: float
    base: bool
    marks: tuple[str, ...] = ()

    @property
    def need(self) -> int:
        """Distinct words a block must share."""
        return max(1, math.ceil(self.threshold * len(set(self.words)) - 1e-9))


def templates() -> list[Template]:
    return [Template(p, x, p.split(), 1.0, True) for p, x in PHRASES.items()] + [
        Template(p, x, p.split(), CONTAINMENT, False, next((m for k, m in MARKS.items() if p.startswith(k)), ())) for p, x in STATEMENTS.items()]


def text_words(text: Column) -> Column:
    """Words of the A-Z lower-cased text; ``lower`` does it where all of the
    word is ASCII."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def frequency_order(words: DataFrame, known: list[Template]) -> list[str]:
    """The templates' words, rarest in the corpus first, ties by the word.
    Words of no template can't add to a containment and need no place in the
    order. ``words`` (word) has every word of every document."""
    vocabulary = sorted({w for t in known for w in t.words})
    counts = words.where(F.col("word").isin(vocabulary)).groupBy("word").count().collect()
    total = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (total.get(w, 0), w))


def license_matches(docs: DataFrame, text: str = "text", known: list[Template] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document and matching (block, template), and one row with
    NULLs for a document without: ``row`` (its number), the ``keep`` columns,
    ``n_words``, ``block`` (first word), ``template`` (position in ``known``),
    ``containment``, and ``places``, the words at which the whole template
    stands consecutively and which the block owns."""
    spark = docs.sparkSession
    known = templates() if known is None else known
    order = frequency_order(docs.select(F.explode(text_words(col(text))).alias("word")), known)
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted({rank[w] for w in t.words}) for t in known]
    index = [(r, n, i, s, t.need, t.words, [m.split("|") for m in t.marks]) for n, (t, s) in enumerate(zip(known, sets, strict=True)) for i, r in enumerate(s[: len(s) - t.need + 1])]
    prefixes = spark.createDataFrame([(*x[:3], x[3], *x[4:]) for x in index], "rank int, template int, i int, ranks array<int>, need int, words array<string>, marks array<array<string>>")
    if len(index) <= BROADCAST_ROWS:
        prefixes = F.broadcast(prefixes)
    stride = max([MIN_STRIDE, *(len(t.words) for t in known)])
    rare = sorted({order[x[0]] for x in index})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[col(c) for c in keep], text_words(col(text)).alias("w"))
    rows = rows.withColumn("hits", F.filter(F.transform("w", lambda w, i: F.when(w.isin(rare), F.floor(i / stride).cast("int"))), lambda x: x.isNotNull()))
    owners = F.filter(F.array_distinct(F.flatten(F.transform("hits", lambda b: F.array(b - 1, b)))), lambda b: b >= 0)
    cut = F.transform(owners, lambda b: F.struct((b * stride).alias("block"), F.slice("w", b * stride + 1, F.lit(2 * stride)).alias("tokens")))
    blocks = rows.select("row", *keep, F.size("w").cast("long").alias("n_words"), F.explode_outer(cut).alias("b")).select("row", *keep, "n_words", "b.*")
    places = F.array(*[F.lit(w) for w in order])
    own = F.transform(F.filter("tokens", lambda w: w.isin(order)), lambda w: (F.array_position(places, w) - 1).cast("int"))
    blocks = blocks.withColumn("own", F.array_sort(F.array_distinct(own)))
    least = min((t.need for t in known), default=1)
    prefix = F.slice("own", F.lit(1), F.greatest(F.size("own") - least + 1, F.lit(0)))
    probes = blocks.select("row", *keep, "n_words", "block", "tokens", "own", F.posexplode_outer(prefix).alias("j", "shared"))
    most_left = 1 + F.least(F.size("own") - F.col("j"), F.size("ranks") - F.col("i")) - 1
    common = F.array_intersect("own", "ranks")
    # each (block, template) is found once: by the rarest word they share
    joined = probes.join(prefixes, (F.col("shared") == F.col("rank")) & (F.size("own") >= F.col("need")) & (most_left >= F.col("need")), "left")
    joined = joined.withColumn("common", F.when(F.col("template").isNotNull(), common))
    match = F.coalesce((F.size("common") >= F.col("need")) & (F.element_at("common", 1) == F.col("shared")), F.lit(False))

    def marked(s: Column) -> Column:
        """The window at word ``s`` of a block has all marks and the template's share."""
        window = F.slice("tokens", s + 1, F.least(2 * F.size("words"), F.lit(stride)))
        line = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        marks = F.forall("marks", lambda m: F.exists(m, lambda x: F.contains(line, F.concat(F.lit(" "), x, F.lit(" ")))))
        return marks & (F.size(F.array_intersect(window, F.col("words"))) >= F.col("need"))

    match = F.when(match, (F.size("marks") == 0) | F.exists(F.sequence(F.lit(0), F.size("tokens") - 1), marked)).otherwise(False)
    start = F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda s: F.slice("tokens", s + 1, F.size("words")) == F.col("words"))
    return joined.select("row", *keep, "n_words", "block", F.when(match, F.col("template")).alias("template"),
                         F.when(match, F.size("common") / F.size("ranks")).alias("containment"),
                         F.when(match, F.transform(start, lambda s: (F.col("block") + s).cast("long"))).alias("places"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = templates()
    found = license_matches(read_documents(spark, sf_dir).select("doc_id", "text"), known=known)
    base = F.coalesce(F.col("template").isin([n for n, t in enumerate(known) if t.base]), F.lit(False))
    label = F.element_at(F.array(*[F.lit(t.label) for t in known]), F.col("template") + 1)
    placed = base & (F.size("places") > 0)
    good = placed | (F.col("template").isNotNull() & ~base)
    per = found.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(placed, F.size("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(placed, F.array_min("places"))).alias("first_word"), F.max(F.when(placed, F.array_max("places"))).alias("last_word"),
        F.collect_set(F.when(placed, label)).alias("b"), F.collect_set(F.when(good, label)).alias("a"), F.max(F.when(good, F.col("containment"))).alias("top"))
    return per.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("b"), ",").alias("base_labels"),
                      F.array_join(F.array_sort("a"), ",").alias("labels"), F.coalesce("top", F.lit(0.0)).alias("score"))


def _sql() -> str:
    """Every block against every template, every window of a block that shares
    enough against the marks, and phrase places from the words in order."""
    known = templates()
    rows = ", ".join(f"({n}, '{t.label}', {t.words!r}, {t.need}, {str(t.base).lower()}, {[m.split('|') for m in t.marks]!r}::VARCHAR[][])" for n, t in enumerate(known))
    stride = max([MIN_STRIDE, *(len(t.words) for t in known)])
    return rf"""
WITH t(n, label, words, need, base, marks) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i, w FROM d),
places AS (SELECT p.doc_id, p.i, t.label FROM p JOIN t ON t.base AND p.a = t.words[1] AND p.w[p.i + 1:p.i + len(t.words)] = t.words),
b AS (SELECT doc_id, unnest(list_transform(range(0, len(w), {stride}), lambda s: w[s + 1:s + {2 * stride}])) AS tokens FROM d),
m AS (SELECT doc_id, t.n, tokens, label, words, need, marks, len(list_intersect(list_distinct(tokens), list_distinct(t.words))) AS shared, len(list_distinct(t.words)) AS size
      FROM b JOIN t ON NOT t.base WHERE len(list_intersect(list_distinct(tokens), list_distinct(t.words))) >= need),
s AS (SELECT doc_id, n, label, need, marks, shared / size AS score, tokens, words, unnest(list_transform(range(len(tokens)), lambda i: tokens[i + 1:i + least(2 * len(words), {stride})])) AS piece FROM m),
g AS (SELECT DISTINCT doc_id, label, score FROM s
      WHERE len(list_intersect(list_distinct(piece), list_distinct(words))) >= need
        AND list_bool_and(list_transform(marks, lambda m: list_bool_or(list_transform(m, lambda x: contains(' ' || array_to_string(piece, ' ') || ' ', ' ' || x || ' ')))))
      UNION ALL SELECT doc_id, label, 1.0 FROM places)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (SELECT count(*) FROM places x WHERE x.doc_id = d.doc_id) AS n_base,
       (SELECT min(i)::BIGINT FROM places x WHERE x.doc_id = d.doc_id) AS first_word, (SELECT max(i)::BIGINT FROM places x WHERE x.doc_id = d.doc_id) AS last_word,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places x WHERE x.doc_id = d.doc_id), '') AS base_labels,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM g x WHERE x.doc_id = d.doc_id), '') AS labels,
       coalesce((SELECT max(score) FROM g x WHERE x.doc_id = d.doc_id), 0)::DOUBLE AS score
FROM d
"""


SQL = _sql()
