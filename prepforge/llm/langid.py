"""Language identification by compression (operator 6).

Every language gets a zstandard raw-content dictionary made of excerpts of its
training texts. A text is compressed in blocks of ``BLOCK`` bytes with each
language's dictionary; the language with the smallest total wins, and the
prediction is *rejected* where the runner-up is nearly as small.

The dictionary is the only thing that is fitted, on a bounded sample:
``DOCS_PER_LANG`` documents per language, ``EXCERPT`` code points of each.
Prediction reads whole texts.

Defined results: a NULL text, or one without a letter, is ``und`` with score
0, rejected. Ties go to the language that sorts first, score 0, rejected.
Without any training text all documents are ``und``. With one learned language
its score is 1. Rows with NULL label, NULL text or NULL ``doc_id`` teach
nothing. Repeated rows are predicted one by one, each alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepforge.llm.util import col, fresh, read_documents

#: Training bound: documents per language and code points of each.
DOCS_PER_LANG = 256
EXCERPT = 512
#: Bytes compressed at once: the dictionary counts as much in long texts as in short ones.
BLOCK = 4096
LEVEL = 6
#: A short text gets so many spaces after it: zstandard would store it raw, at the same size for all languages.
PAD = 256
#: A prediction whose runner-up is less than this share larger is rejected.
MIN_MARGIN = 0.005

RESULT = "lang_pred string, score double, rejected boolean"


class Model(NamedTuple):
    """Learned languages in order, and the raw-content dictionary of each."""

    langs: list[str]
    dictionaries: list[bytes]


def learn(docs: DataFrame, train: Column, text: str = "text", label: str = "lang",
          docs_per_lang: int = DOCS_PER_LANG, excerpt: int = EXCERPT) -> Model:
    """Dictionaries from a sample in hash order, of distinct texts; per
    language at most ``docs_per_lang * excerpt`` code points reach the driver.
    Copies share a hash and are dropped before places are given, in a shuffle
    of labels and hashes only; a second pass fetches the excerpts."""
    room = F.greatest(F.length("t") - F.lit(excerpt) + 1, F.lit(1))
    sample = (docs.where(train & col(text).isNotNull() & col(label).isNotNull())
              .select(col(label).cast("string").alias("l"), col(text).alias("t"), F.xxhash64(col(text), F.lit("sample")).alias("h"))
              .where(F.col("t").rlike(r"\p{L}")))
    top = Window.partitionBy("l").orderBy("h")
    first = sample.select("l", "h").distinct().select("l", "h", F.row_number().over(top).alias("n")).where(F.col("n") <= docs_per_lang)
    cut = F.substring(F.col("t"), (F.pmod(F.col("h"), room) + 1).cast("int"), F.lit(excerpt))
    rows = sample.join(F.broadcast(first), ["l", "h"]).select("l", "n", cut.alias("t")).groupBy("l", "n").agg(F.min("t").alias("t")).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["n"])):
        by.setdefault(r["l"], []).append(r["t"])
    langs = sorted(by)
    return Model(langs, [" ".join(by[x]).lower().encode() for x in langs])


def predict(texts: Iterator[str | None], model: Model, block: int = BLOCK, level: int = LEVEL,
            min_margin: float = MIN_MARGIN) -> Iterator[tuple[str, float, bool]]:
    """(language, score, rejected) of each text."""
    coders = []
    for content in model.dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False,
                                               write_dict_id=False).compress)
    ascii_letter = re.compile("[A-Za-z]").search
    for text in texts:
        if text is None or not coders or not (ascii_letter(text) or any(map(str.isalpha, text))):
            yield "und", 0.0, True
            continue
        body = text.lower().encode()
        if len(body) <= PAD:
            body += b" " * PAD
        parts = [body] if len(body) <= block else [body[i:i + block] for i in range(0, len(body), block)]
        sizes = [sum(len(c(p)) for p in parts) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        score = 1.0 if rest is None else (rest - sizes[best]) / rest
        yield model.langs[best], score, score < min_margin


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language", block: int = BLOCK,
             level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with a struct column ``out`` (``lang_pred``, ``score``,
    ``rejected``); all other columns stay in the JVM."""

    @F.arrow_udf(RESULT)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = list(predict((x.as_py() for x in batch), model, block, level, min_margin))
            lang, score, no = zip(*found) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())],
                                             ["lang_pred", "score", "rejected"])

    return docs.withColumn(out, classify(col(text)))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(col(doc_id).cast("string").cast("binary")) % 5


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs, learn(docs, fold() != 0))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score",
                      "language.rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    name = fresh(docs, "language")
    out = identify(docs, learn(docs, fold() != 0), out=name)
    return out.where(~F.col(f"{name}.rejected")).select(*[col(c) for c in docs.columns])
