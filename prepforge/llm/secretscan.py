"""Secret scans (operator 10), in DataFrame operations.

Three pattern kinds are the base: assignments to password-like names, access
keys, long hexadecimal runs. The method adds kind ``markov``: two first-order
character Markov models, of random strings and of ordinary identifiers, are
counted from labelled samples; a long token whose mean log-likelihood ratio
per character exceeds ``MIN_RATIO`` is a secret, unless it lies within a base span.

Training samples of label random: strings drawn by hash from each alphabet of
``RANDOM``, and the values that the base patterns find in all texts, which
count at most as much as one alphabet. Of label ordinary: the words of about
``SAMPLE_DOCS`` documents, taken by hash, outside the base patterns' matches,
as they stand, in upper case, and joined to identifiers with and without
numbers; long words with digits could be secrets and teach nothing. Only the character-pair counts reach the driver; they are bounded by the alphabet.
Every whole text is scanned.

Match positions come from the pieces around the matches (``split`` and
``regexp_extract_all`` see the same matches), in code points.

Defined results: NULL text is empty. Without ordinary words the model adds no
span. Rows are scanned one by one, repeated ones alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.util import col, fresh, let, read_documents

# The base patterns, kinds in order of listing (letters of the names in either case).
NAMES = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
MIN_VALUE = 6

#: Tokens the models judge, and ordinary words they learn from.
TOKEN = "[A-Za-z0-9+/_-]{16,}"
WORD = "[A-Za-z0-9_-]{5,}"
#: A word this long is judged itself.
LONG = 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_LOWER, _UPPER, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets of random strings, so many strings of each, and their length.
RANDOM = {"hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "upper": _UPPER + _DIGITS, "lower": _LOWER + _DIGITS,
          "base62": _LOWER + _UPPER + _DIGITS, "base64": _LOWER + _UPPER + _DIGITS + "+/", "base64url": _LOWER + _UPPER + _DIGITS + "-_"}
RANDOM_TOKENS, RANDOM_CHARS = 2000, 32
#: About how many documents give ordinary words.
SAMPLE_DOCS = 2000
#: Mean log-likelihood ratio (nats a character) above which a token is random.
MIN_RATIO = 1.5
MASK = "[SECRET]"

_CHUNK = 256
_BLOCK = 4096


def _running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """All entries up to each one, joined; in runs, so that it stays near-linear.
    Arrays are bound before they are looked into: a lambda that named a column
    would work it out anew for each element."""
    def scan(x: Column) -> Column:
        whole = lambda a: F.aggregate(a, zero, join)
        run = lambda i: F.floor(i / _CHUNK).cast("int")
        runs = F.transform(F.sequence(F.lit(0), run(F.size(x) - 1)), lambda r: whole(F.slice(x, r * _CHUNK + 1, F.lit(_CHUNK))))
        heads = lambda rs: F.transform(rs, lambda _, i: whole(F.slice(rs, F.lit(1), i)))
        return let(let(runs, heads), lambda before: F.transform(x, lambda _, i: join(
            F.element_at(before, run(i) + 1), whole(F.slice(x, run(i) * _CHUNK + 1, (i % _CHUNK + 1).cast("int"))))))
    return let(values, lambda x: F.when(F.size(x) > 0, scan(x)).otherwise(F.slice(x, 1, 0)))


_SPANS = "array<struct<s:bigint,e:bigint,v:string>>"


def _spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Per pattern an array of (s, e, v): limits in code points, end exclusive,
    and the first group, or the match itself. Leftmost, non-overlapping."""
    def spans(pattern: str, hits: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if re_groups(pattern) else hits
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        steps = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(hits)), hits, lambda x, h: x + F.length(h))
        ends = _running(let(gaps, steps), lambda x, y: x + y, F.lit(0).cast("long"))
        ended = lambda e: F.zip_with(e, hits, lambda x, h: F.struct((x - F.length(h)).alias("s"), x.alias("e")))
        return F.zip_with(let(ends, ended), values, lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v")))

    def found(pattern: str) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans(pattern, hits)).otherwise(F.array().cast(_SPANS)))

    return df.withColumns({k: found(p) for k, p in patterns.items()})


def re_groups(pattern: str) -> bool:
    return "(" in pattern.replace("(?:", "")


def base_spans(df: DataFrame, text: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Columns assign, access, hex (and those of ``extra`` patterns)."""
    out = _spans(df, text, PATTERNS | (extra or {}))
    return out.withColumn("assign", F.filter("assign", lambda x: F.length(x["v"]) >= MIN_VALUE))


def random_strings(spark: SparkSession, n: int = RANDOM_TOKENS, chars: int = RANDOM_CHARS) -> DataFrame:
    """(part, token): ``n`` strings of each alphabet, the same in every run."""
    letters = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(a).alias("a")) for k, a in RANDOM.items()])
    rows = spark.range(n).select("id", F.explode(letters).alias("x")).select("id", "x.*")
    draw = lambda i: F.substr(F.col("a"), (F.pmod(F.xxhash64("id", "part", i), F.length("a")) + 1).cast("int"), F.lit(1))
    return rows.select("part", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(chars)), draw), "").alias("token"))


def identifiers(words: Column, seed: Column) -> Column:
    """Words as they stand, in upper case, and every three of them joined in
    four ways; each joined word has a number after it one time in eight."""

    def numbered(w: Column, i: Column) -> Column:
        h = F.xxhash64(w, i, seed)
        return F.when(F.pmod(h, F.lit(8)) == 0, F.concat(w, F.pmod(F.shiftright(h, 3), F.lit(1000)).cast("string"))).otherwise(w)

    first = F.filter(F.transform(words, lambda _, i: i), lambda i: (i % 3 == 0) & (i + 3 <= F.size(words)))
    threes = F.transform(first, lambda i: F.transform(F.slice(words, i + 1, F.lit(3)), lambda w, k: numbered(w, i + k)))
    hump = lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    join = lambda form, sep: F.transform(threes, lambda t: F.array_join(F.transform(t, form), sep))
    lower, upper = lambda w: F.lower(w), lambda w: F.upper(w)
    return F.concat(words, F.transform(words, upper), join(lower, "_"), join(upper, "_"), join(hump, ""), join(lower, "-"))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(random, part, token): strings of all alphabets, and values and words
    from the texts themselves."""
    texts = docs.select(F.coalesce(col("text"), F.lit("")).alias("t"), F.xxhash64(col("doc_id"), col("text"), F.lit("train")).alias("h"))
    secrets = base_spans(texts.select("t"), "t").select(F.explode(F.concat(
        F.transform("assign", lambda x: x["v"]), F.transform("access", lambda x: F.substr(x["v"], F.lit(5))), F.transform("hex", lambda x: x["v"]))).alias("token"))
    n = docs.count()
    some = texts.where(F.pmod("h", F.lit(max(n, 1))) < sample_docs)
    plain = F.regexp_replace("t", "|".join(f"(?:{p})" for p in PATTERNS.values()), " ")
    words = F.filter(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) < LONG) | ~w.rlike("[0-9]"))
    some = some.select(F.explode(let(words, lambda w: identifiers(w, F.col("h")))).alias("token"))
    return (random_strings(docs.sparkSession).select(F.lit(True).alias("random"), "part", "token")
            .unionAll(secrets.select(F.lit(True), F.lit("found"), "token")).unionAll(some.select(F.lit(False), F.lit("words"), "token")))


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of all character pairs (add-one smoothed; the
    first row is the start of a token), or None if a label has no sample.
    Where samples have a ``part``, values found in texts count in proportion,
    as many characters as one alphabet's strings at most."""
    k = len(ALPHABET)
    token = F.concat(F.lit("^"), F.col("token"))
    part = F.col("part") if "part" in samples.columns else F.lit("")
    pairs = samples.where(F.length("token") > 0).select("random", part.alias("part"), F.explode(F.transform(
        F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substr(token, i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("random", "part", "pair").count().collect()
    found = sum(r["count"] for r in counts if r["part"] == "found")
    share = min(1.0, RANDOM_TOKENS * RANDOM_CHARS / found) if found else 1.0
    table = {x: [[1.0] * k for _ in range(k + 1)] for x in (True, False)}
    for r in counts:
        a, b = ALPHABET.find(r["pair"][0]) + 1, ALPHABET.find(r["pair"][1])
        if b >= 0:
            table[r["random"]][a][b] += r["count"] * (share if r["part"] == "found" else 1)
    if {r["random"] for r in counts} != {True, False}:
        return None
    part = {x: [[math.log(c / sum(row)) for c in row] for row in t] for x, t in table.items()}
    return [round(p - q, 5) for rows in zip(part[True], part[False], strict=True) for p, q in zip(*rows, strict=True)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a token over ``ALPHABET``."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))
    sums = F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(0.0), lambda acc, i: acc + F.element_at(
        table, F.when(i == 1, F.lit(0)).otherwise(at(i - 1)) * len(ALPHABET) + at(i)))
    return sums / F.length(token)


def scan(df: DataFrame, text: str, model: list[float] | None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``df`` with the arrays assign, access, hex and markov; ``text`` not NULL."""
    out = base_spans(df, text, {"markov": TOKEN})
    if model is None:
        return out.withColumn("markov", F.slice("markov", 1, 0))
    # a token lies within a base span if one that begins no later ends no earlier:
    # all by start, base spans first, with the last end so far
    tagged = lambda k, n: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), x["v"].alias("v")))
    merged = F.array_sort(reduce(lambda a, b: F.concat(a, b), [*[tagged(k, 0) for k in PATTERNS], tagged("markov", 1)]))

    def beyond(every: Column) -> Column:
        last = _running(F.transform(every, lambda x: F.when(x["n"] == 0, x["e"]).otherwise(F.lit(-1).cast("long"))), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))
        kept = F.filter(F.zip_with(every, last, lambda x, e: F.struct(x.alias("x"), e.alias("last"))), lambda y: (y["x"]["n"] == 1) & (y["last"] < y["x"]["e"]) & (log_ratio(y["x"]["v"], model) > min_ratio))
        return F.transform(kept, lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["v"].alias("v")))

    return out.withColumn("markov", F.when(F.size("markov") > 0, let(merged, beyond)).otherwise(F.slice("markov", 1, 0)))


def listing(kinds: list[str]) -> Column:
    """kind:start:end of the spans by start, then kind as listed."""

    def tag(k: str, n: int) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e")))

    tagged = [tag(k, n) for n, k in enumerate(kinds)]
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(reduce(lambda a, b: F.concat(a, b), tagged)),
                                    lambda x: F.concat_ws(":", F.element_at(name, x["n"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = scan(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", train(labelled_samples(docs)))
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *n, F.sha2(listing(list(PATTERNS)), 256).alias("base_sha256"), listing([*PATTERNS, "markov"]).alias("spans"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with its (sorted) spans replaced; overlapping ones together.
    Pieces are cut from blocks of the text, not from its beginning."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / _BLOCK).cast("int")), lambda i: F.substr(text, i * _BLOCK + 1, F.lit(_BLOCK)))

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _BLOCK).cast("int")
        near = F.slice(parts, first + 1, F.floor((b - 1) / _BLOCK).cast("int") - first + 1)
        return F.when(b > a, F.substr(F.array_join(near, ""), (a - first * _BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def cut(x: Column, last: Column) -> Column:
        # what follows the last end so far opens a new hole
        limits = F.zip_with(x, F.concat(F.array(F.lit(-1).cast("long")), F.slice(last, F.lit(1), F.size(last) - 1)), lambda y, e: F.struct(y["s"].alias("s"), e.alias("e")))
        opened = F.filter(limits, lambda y: y["s"] > y["e"])
        heads = F.concat(F.transform(opened, lambda y: y["s"]), F.array(F.length(text).cast("long")))
        ends = F.concat(F.transform(opened, lambda y: F.greatest(y["e"], F.lit(0).cast("long"))), F.array(F.element_at(last, -1)))
        return let(blocks, lambda parts: F.array_join(F.zip_with(ends, heads, lambda a, b: piece(parts, a, b)), mask))

    return let(spans, lambda x: let(_running(F.transform(x, lambda y: y["e"]), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long")), lambda last: cut(x, last)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every secret is replaced by ``[SECRET]``; documents stay,
    ``n_chars`` follows the text."""
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), F.coalesce(col("text"), F.lit("")).alias("t"))
    found = scan(packed, "t", train(labelled_samples(docs)))
    spans = F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in [*PATTERNS, "markov"]]))
    found = found.select(row, "t", spans.alias("spans")).select(row, "spans", F.when(F.size("spans") > 0, masked(F.col("t"), F.col("spans"))).alias("clean"))
    new = {"text": F.coalesce("clean", F.col(row)["text"]), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(row)["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if new.get(c) is not None else F.col(row)[c]).alias(c) for c in docs.columns])
