"""Quality rules (operator 9), in DataFrame operations.

Counts over whole texts (words, symbols, repeated lines, words in repeated
three-word windows) and a verdict: the hashed n-gram log-likelihood ratio
between a trusted-target and the raw-corpus multinomial, divided by the number
of n-grams, must reach ``MIN_RATIO``. The target is what ``labels`` calls good
(quality 1, not toxic); the raw model counts every document. Nothing is drawn
at random: a document's verdict follows from its text and the two models.

Defined results: NULL or blank text has no words and fails the base. Without
any target document only the base decides. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.ngrams import buckets, flag_targets, log_ratios, summed, words
from prepforge.llm.util import col, let, read_documents

BUCKETS = 16384
MIN_RATIO = -0.1
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def repeated_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """``out``: words of array ``w`` that a three-word window found twice or
    more covers. Windows are compared by 64-bit hash: the values that stand
    next to an equal one in sorted order are repeated, and a window looks its
    value up in one of about sqrt(windows) lists, so that a long text takes
    far less than the square of its windows."""
    n = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    h, s, one, two = f"{out}_h", f"{out}_s", f"{out}_1", f"{out}_2"
    tail = lambda a, k: F.slice(a, F.lit(k + 1), n)
    hashed = df.withColumn(one, F.transform(w, lambda x: F.xxhash64(x)))
    hashed = hashed.withColumn(two, F.zip_with(tail(one, 0), tail(one, 1), lambda x, y: F.xxhash64(x, y)))
    hashed = hashed.withColumn(h, F.zip_with(two, tail(one, 2), lambda x, y: F.xxhash64(x, y))).drop(one, two)
    hashed = hashed.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))

    def covered(lists: Column) -> Column:
        again = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(F.element_at(lists, (F.pmod(x, F.size(lists)) + 1).cast("int")), x), i)), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    def dealt(twice: Column) -> Column:
        # a lambda never refers to a column: a filter pushed below would compute it for each element
        return let(F.ceil(F.sqrt(F.size(h))).cast("int"), lambda n: F.transform(
            F.sequence(F.lit(0), n - 1), lambda k: F.filter(twice, lambda x: F.pmod(x, n) == k)))

    repeated = let(F.col(s), lambda srt: F.array_distinct(F.filter(srt, lambda x, i: (i > 0) & (x == F.get(srt, i - 1)))))
    count = let(repeated, lambda twice: let(dealt(twice), covered))
    return hashed.withColumn(out, F.when(F.col(s).isNotNull(), count).otherwise(0).cast("long")).drop(h, s)


def text_counts(df: DataFrame, text: str, w: str) -> DataFrame:
    """The base counts of ``text`` (not NULL) with its words in array ``w``."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = repeated_words(df, w, "n_repeat_words").withColumn("lines", lines)
    return out.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, n: int = BUCKETS) -> list[float] | None:
    """Bucket log ratios; None without any target document."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    flagged = flag_targets(docs.select(col("doc_id").alias("doc_id"), words(col("text")).alias("w")), good, "target")
    ratios = log_ratios(flagged, n)
    return ratios if len(set(ratios)) > 1 else None


def judge(docs: DataFrame, ratios: list[float] | None, min_ratio: float = MIN_RATIO, n: int = BUCKETS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, ``base_failed``, ``ratio`` (NULL without n-grams) and ``kept``."""
    rows = docs.select(*[col(c) for c in keep], F.coalesce(col("text"), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    grams = buckets(F.col("w"), n)
    ratio = F.lit(None).cast("double") if ratios is None else F.when(F.size("w") > 0, summed(grams, ratios) / (2 * F.size("w") - 1))
    out = text_counts(rows, "t", "w").withColumn("ratio", ratio).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= min_ratio, F.lit(True))).drop("t", "w")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    ratios = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
