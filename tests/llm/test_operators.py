"""Every corpus query on a messy corpus, against plain Python."""

import base64
import hashlib
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import (SCHEMA, VECTORS, alnum, benchmark, components, corpus, counts, decontaminated, fingerprint, fold, grams, labels, listed, log_ratios, masked, mixed, secrets, spaced,
                   vectors, without_repeats)
from prepforge.llm import decontam, langid, licenses, mixing, qualityrules, resampling, revisits, secretscan, simhash, substrings
from prepforge.llm.queries import ORACLE, QUERIES
from prepforge.llm.util import read_documents


def write(spark, path, docs, items, marks):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, u, None if i == 3 else f"<p>{i % 2}</p>") for i, u in enumerate(
        ["http://www.a.com/x/#f", "https://A.com/x?utm_x=1", "a.com/nothost", None, "http://b.org:80/index.html", "https://b.org", "https://b.org/?b=2&a=1&ref=z", ""])] + [(None, "http://a.com/x", "z"), (5, "https://b.org", "<p>1</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    return write(spark, tmp_path_factory.mktemp("messy"), rows, benchmark(rows), labels())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, kind in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", VECTORS)):
        spark.createDataFrame([], kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def ran(spark, sf):
    """Each query's frame and rows on the messy corpus, run once."""
    done = {}

    def run(name):
        if name not in done:
            df = QUERIES[name](spark, sf)
            done[name] = df, df.collect()
        return done[name]

    return run


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(ran, name):
    want = {"op1": "doc_id n_words n_base first_word last_word base_labels labels score", "op4": "doc_id n_words n_hit n_items items_sha256 contaminated",
            "op5": "doc_id size source_size target taken", "op6": "doc_id held_out lang_pred score", "op7": "doc_id n_words n_removed kept_sha256",
            "op8": "doc_id fingerprint component_id", "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
            "op10": "doc_id n_assign n_access n_hex base_sha256 spans", "op11": "anchor_id positive_id rank negative_id positive_score negative_score",
            "op12": "doc_id start n_tokens ids_crc32", "op13": "lang rank phrase a l r n score"}.get(name.split("_")[0], "")
    df, got = ran(name)
    assert set(want.split()) <= set(df.columns)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in want.split() if c.startswith("n_") or c in (
        "size", "source_size", "taken", "first_word", "last_word", "doc_id", "component_id", "start", "ids_crc32", "anchor_id", "positive_id", "negative_id", "positive_score",
        "negative_score", "a", "l", "r", "n"))
    if name not in ("op3_warc_revisits", "op11_hard_negatives", "op13_collocations"):
        assert len(got) == len(corpus())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_sql(spark, name):
    import duckdb
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    got = QUERIES[name](spark, at)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    same(got.select(*cols).collect(), cur.fetchall())


# ------------------------------------------------------------------ operator 1

def test_licenses(spark, sf, ran, rows):
    known = licenses.templates()
    want = []
    for r in rows:
        w, places, base, all_labels, best = alnum(r[1]), [], set(), set(), 0.0
        for t in known:
            n = len(t.words)
            if t.base:
                at = [s for s in range(len(w) - n + 1) if w[s:s + n] == t.words]
                places += at
                if at:
                    base.add(t.label)
                    best = 1.0
            else:
                for b in range(0, len(w), 32):
                    share = len(set(w[b:b + 64]) & set(t.words))
                    if share >= t.need:
                        all_labels.add(t.label)
                        best = max(best, share / len(set(t.words)))
        want.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | all_labels)), best))
    same(ran("op1_license_scan")[1], want)
    assert any(x[2] == 4 for x in want)


def test_license_phrases_across_blocks(spark):
    texts = [" ".join(["x"] * n + ["all", "rights", "reserved"] + ["x"] * 40) for n in range(70)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    known = [licenses.Template("r", "r", ["all", "rights", "reserved"], 1.0, True)]
    got = licenses.license_matches(df, known=known).selectExpr("doc_id", "explode(places) as p").collect()
    same(got, [(n, n) for n in range(70)])


def test_licenses_by_their_names(spark, tmp_path):
    """The words that name a license must stand together; other lines get no such label."""
    want = {"licensed under cc by 4 0": "cc-by", "licensed under cc by sa 4 0": "cc-by", "licensed under cc by nc sa 4 0": "cc-by", "released under the bsd license": "",
            "licensed under a creative commons attribution license": "", "this work is licensed under the gnu general public license version 2": "gpl",
            "licensed under the gnu general public license version 2 0": "gpl", "this work is licensed under the gnu lesser general public license version 3": "gpl",
            "released under the bsd license " + "x " * 20 + "at mit": "", "permission is hereby granted free of charge to any person obtaining a copy of the font software": "",
            **{p: x for p, x in licenses.STATEMENTS.items() if x not in ("gpl-3.0", "cc-by-nc-4.0")},
            "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0", "this work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
            "licensed under the apache license 2 0": "apache-2.0", "licensed under a creative commons attribution share alike license": "cc-by-sa", "released under the mit licence": "mit"}
    # at every place relative to the blocks
    docs = [(i, "y " * n + t + " z" * 40) for i, t in enumerate(want) for n in (0, 25, 31, 50, 63)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["labels"]) for r in licenses.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == set(enumerate(want.values()))
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest($1) AS doc_id, unnest($2) AS text", [list(range(len(want))), [f"y y {t} z z" for t in want]])
    assert {r[0]: r[6] for r in con.execute(licenses.SQL).fetchall()} == dict(enumerate(want.values()))


# ------------------------------------------------------------------ operator 2

def test_importance_resampling(spark, sf, ran, rows):
    good = {i for i, q, t in labels() if q == 1 and not t and i is not None}
    ratios = log_ratios([r[1] for r in rows], [r[0] in good for r in rows], resampling.BUCKETS)
    got = ran("op2_importance_resampling")[1]
    weight = {(r[0], round(sum(ratios[b] for b in grams(r[1], resampling.BUCKETS)), 1)) for r in rows}
    assert all(any(i == r["doc_id"] and abs(x - r["log_weight"]) < 0.2 + abs(x) * 1e-3 for i, x in weight) for r in got)
    k = round(resampling.KEEP * len(rows))
    cut = sorted((r["score"] for r in got), reverse=True)[k - 1]
    assert all(r["kept"] == (r["score"] >= cut) for r in got)
    assert sum(r["kept"] for r in got) >= k
    noise = [r["score"] - r["log_weight"] for r in got]
    assert len(set(noise)) > 50 and -3 < sum(noise) / len(noise) < 3
    assert sorted(map(tuple, resampling.op2_importance_resampling(spark, sf).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_resampling_prefers_target(spark):
    at = "/root/testdata/sf0.01"
    got = resampling.op2_importance_resampling(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    share = lambda x: sum(r["kept"] for r in x) / len(x)
    assert share([r for r in got if r["quality"] == 1]) > 0.9 and share([r for r in got if r["quality"] == 0]) < 0.4


# ------------------------------------------------------------------ operator 3

def test_revisits(spark, sf):
    recs = revisits.page_records(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    got = {}
    for r in revisits.resolve(spark.createDataFrame(recs, revisits.page_records(spark.read.parquet(f"{sf}/pages.parquet")).schema)).collect():
        got.setdefault(r["record_id"], []).append((r["status"], r["ref_id"]))
    fulls = [r for r in recs if r["full"] and r["canonical"] is not None and r["ts"] is not None]
    for r in recs:
        if r["full"]:
            want = ("response", None)
        else:
            before = [f for f in fulls if r["ts"] is not None and f["canonical"] == r["canonical"] and f["ts"] < r["ts"]]
            ref = max(before, key=lambda f: (f["ts"], f["record_id"]), default=None)
            if ref is None:
                want = ("missing", None)
            else:
                weak = lambda x: x.removeprefix("W/") if x else x
                pairs = [(weak(r["etag"]), weak(ref["etag"])), (r["last_modified"], ref["last_modified"]), (r["digest"], ref["digest"])]
                both = [a == b for a, b in pairs if a is not None and b is not None]
                want = ("unverified" if not both else "resolved" if both[0] else "mismatch", ref["record_id"])
        assert want in got[r["record_id"]], (r, want, got[r["record_id"]])
    assert sum(map(len, got.values())) == len(recs)


def test_canonical_urls(spark):
    """Expected by hand; URLs that name no host have none, and their revisits find no response."""
    want = {"http://www.a.com/x/#f": "a.com/x", "https://A.com/x?utm_x=1": "a.com/x", "https://b.org/?b=2&a=1&ref=z": "b.org?a=1&b=2", "http://b.org:80/index.html": "b.org",
            "a.com/nothost": "a.com/nothost", "WWW.a.com/x/": "a.com/x", "//a.com/x": "a.com/x", "a.com:443": "a.com", "a.com?q=1": "a.com?q=1", "10.0.0.1/p": "10.0.0.1/p",
            "localhost:8080/p": "localhost:8080/p", "": None, "  ": None, "#top": None, "/rel/page": None, "rel/page": None, "index.html?x=1": None, "mailto:me@a.com": None,
            "?q=1": None, "http://": None, "http:///x": None, None: None}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["c"] for r in df.select("url", revisits.canonical_url(F.col("url")).alias("c")).collect()} == want
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT unnest($1)::BIGINT AS page_id, unnest($2)::VARCHAR AS url, 'x' AS html", [list(range(len(want))), list(want)])
    assert {r[1]: r[2] for r in con.execute(revisits.SQL).fetchall() if r[0][0] == "r"} == dict(enumerate(want.values()))
    pages = [(1, "mailto:me@a.com"), (2, ""), (3, "rel/page"), (4, "a.com/x"), (5, "b.com/x"), (6, "http://a.com/x")]
    df = spark.createDataFrame([(i, u, "same") for i, u in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in revisits.resolve(revisits.page_records(df)).where("not full").collect()}
    assert [(got[i]["ref_id"], got[i]["status"] == "missing") for i in range(1, 7)] == [(None, True)] * 3 + [("r6", False), ("r5", False), ("r6", False)]


def test_revisits_hot_url(spark):
    """One URL in nearly all rows, over many slices; ties in time; merged headers."""
    recs = [(f"f{i:04}", "u", i * 10, True, f'"{i}"', None, None, {"etag": f'"{i}"', "content-length": "9", "vary": "a"}) for i in range(300)]
    recs += [(f"v{i:04}", "u", i * 10 + (5 if i % 2 else 0), False, f'W/"{i}"', None, None, {"etag": f'W/"{i}"', "content-length": "0", "connection": "x"}) for i in range(300)]
    recs += [("z", "v", 3, False, None, None, None, {})]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(recs, "record_id string, canonical string, ts long, full boolean, etag string, last_modified string, digest string, headers map<string,string>")
        got = {r["record_id"]: r for r in revisits.resolve(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 601 and got["z"]["status"] == "missing" and got["v0000"]["status"] == "missing"
    for i in range(1, 300):
        r = got[f"v{i:04}"]
        assert (r["status"], r["ref_id"]) == (("resolved", f"f{i:04}") if i % 2 else ("mismatch", f"f{i - 1:04}"))
        if i % 2:
            assert r["merged"] == {"etag": f'W/"{i}"', "content-length": "9", "vary": "a"}


# ------------------------------------------------------------------ operator 4

@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination(spark, sf, rows, block):
    found = decontam.search(decontam.build_index(read_documents(spark, sf), shard_bytes=5000), spark.read.parquet(f"{sf}/benchmark.parquet"), block_bytes=block)
    want = decontaminated([r[:2] for r in rows], benchmark(rows))
    same(found.select("doc_id", "n_words", decontam.hit_words(), "items").collect(), [(r[0], *x) for r, x in zip(rows, want, strict=True)])
    assert any(x[1] for x in want)


def test_decontamination_query(ran, rows):
    want = decontaminated([r[:2] for r in rows], benchmark(rows))
    got = ran("op4_decontamination")[0].select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    same(got, [(r[0], n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for r, (n, h, i) in zip(rows, want, strict=True)])


def test_decontamination_repeated_items(spark, monkeypatch):
    """Copies of a benchmark row come to the driver once."""
    seen, parse = [], decontam.parse_items
    monkeypatch.setattr(decontam, "parse_items", lambda rows, window: (seen.extend(rows), parse(rows, window))[1])
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")] * 500 + [(8, "alpha beta gamma")], "item_id long, text string")
    got = decontam.search(decontam.build_index(docs), items, block_bytes=60).select("doc_id", "items").collect()
    same(got, [(1, ["8", "9"])])
    assert sorted(seen) == [("8", "alpha beta gamma"), ("9", "alpha beta gamma")]


def test_postings_row_groups(spark):
    """A file may hold many shards; a row group holds one, so a reader never has all at once."""
    docs = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(30)], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(docs, shard_bytes=200)
    sizes = [g.row_group(i).num_rows for f in index.inputFiles() for g in [pq.read_metadata(f.removeprefix("file://"))] for i in range(g.num_row_groups)]
    assert len(index.inputFiles()) == 1 and sizes == [1] * 30


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "gamma far alpha and beta"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = decontam.search(decontam.build_index(docs), items).select("doc_id", "near").collect()
    same(got, [(1, ["9"]), (2, []), (3, [])])


# ------------------------------------------------------------------ operator 5

def test_mixing(spark, sf, ran, rows):
    want = mixed([(r[0], r[1], r[3]) for r in rows])
    same(ran("op5_mixing")[1], want)
    assert all(t <= 3 * n for _, n, _, _, t in want)


def test_mixing_near_target(spark):
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(0.15 * r["max(target)"], r["max(size)"])


# ------------------------------------------------------------------ operator 6

def test_language_id_held_out(spark):
    at = "/root/testdata/sf0.1"
    got = langid.op6_language_id(spark, at).join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.99
    assert sum(r["rejected"] for r in got) / len(got) < 0.005


def test_language_id_edges(spark, sf, ran, rows):
    got = ran("op6_language_id")[1]
    letters = {(r[0], bool(r[1]) and any(map(str.isalpha, r[1]))) for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"]) == 0)
        assert (r["doc_id"], r["lang_pred"] != "und") in letters
        assert r["lang_pred"] in ("und", "de", "en", "fr")


def test_language_id_copies(spark):
    """A thousand copies of one text take one place of the sample."""
    texts = [f"text number {i} of many words that differ {i * i}" for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text", F.lit("sample")).alias("h")).orderBy("h")
    first = df.first()["text"]
    docs = spark.createDataFrame([(t, "en") for t in texts + [first] * 1000], "text string, lang string").repartition(5)
    model = langid.learn(docs, F.lit(True))
    own = model.dictionaries[0].decode()
    assert model.langs == ["en"] and own.count("text number") == langid.DOCS_PER_LANG and own.count(first) == 1


def test_language_id_unlabelled(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "x y", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(docs, langid.learn(docs, langid.fold() != 0)).select("language.*").collect()] == ["und", "und"]


# ------------------------------------------------------------------ operator 7

@pytest.mark.parametrize(("size", "buckets"), [(substrings.CHUNK_BYTES, substrings.LEAST_BUCKETS), (3000, 4)])
def test_substrings(spark, sf, rows, size, buckets):
    got = substrings.dedup_substrings(read_documents(spark, sf), chunk_bytes=size, least_buckets=buckets, with_text=False).collect()
    want = without_repeats([r[:2] for r in rows])
    same(got, want)
    assert any(0 < x[2] < x[1] for x in want)


def test_substrings_on_the_corpus(spark):
    docs = read_documents(spark, "/root/testdata/sf0.001")
    same(substrings.dedup_substrings(docs, chunk_bytes=20_000, with_text=False).collect(), without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()]))


def colliding() -> list[str]:
    """Two words of 1024 letters whose polynomial hashes modulo 2^64 agree for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return ["".join("ab"[b ^ x] for b in bits) for x in (0, 1)]


def test_substrings_colliding_words(spark):
    words, (x, y) = [f"w{i}" for i in range(49)], colliding()
    docs = spark.createDataFrame([(1, " ".join([*words, x])), (2, " ".join([*words, y])), (3, " ".join([*words, x]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 50}


def test_decontamination_colliding_words(spark):
    x, y = colliding()
    docs = spark.createDataFrame([(1, f"alpha {x} beta"), (2, f"alpha {y} beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, f"alpha {y} beta")], "item_id long, text string")
    same(decontam.search(decontam.build_index(docs), items).select("doc_id", "items").collect(), [(1, []), (2, ["9"])])


def test_substrings_rows_are_linear(spark, monkeypatch):
    """However many buckets: never more rows than hash values, and none without values."""
    import numpy as np
    import pyarrow as pa
    texts = [" ".join(f"w{i * 7 % 500 + j}" for j in range(120)) for i in range(40)]
    for bits in (3, 8, 14):
        rows = values = 0
        for lo in range(0, 40, 8):
            b = pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "chunk": pa.array([lo]), "ids": [list(range(lo, lo + 8))], "texts": [texts[lo:lo + 8]]})
            for out in substrings._probe(iter([b]), 50, bits):
                n = np.diff(out.column("probes").offsets.to_numpy())
                assert n.min() > 0
                rows, values = rows + out.num_rows, values + int(n.sum())
        assert rows <= min(values, 5 << bits)


def test_substrings_table_goes_when_a_step_fails(spark, monkeypatch):
    monkeypatch.setattr(substrings, "store", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        substrings.dedup_substrings(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("substring_chunks")]


def test_substrings_text(spark):
    words = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a\n" + " ".join(words[10:70]) + "\tb ä")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substrings.dedup_substrings(docs).collect()}
    assert got == {1: " ".join(words), 2: "a b ä"}


# ------------------------------------------------------------------ operator 8

def test_simhash(spark, sf, ran, rows):
    fps = [fingerprint(r[1]) for r in rows]
    comp = components(fps)
    least = {}
    for c, r in zip(comp, rows, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    same(ran("op8_simhash")[1], [(r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, comp, strict=True)])


@pytest.mark.parametrize("bucket", [2048, 200, 16])
def test_simhash_large_buckets(spark, bucket):
    """Clusters that fill buckets: second blocks and tiles lose no link."""
    import random
    rnd, fps = random.Random(3), []
    for _ in range(4):
        base = x = rnd.getrandbits(64)
        for _ in range(150):
            x ^= 1 << rnd.randrange(64)
            fps.append(x)
            fps.append(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
        fps += [base ^ (rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64)) for _ in range(50)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.link_components(rows, 4, bucket).collect()}
    assert [got[i] for i in range(len(fps))] == components(fps)


def test_xxh64_matches_the_library():
    import random

    import numpy as np
    import xxhash
    from prepforge.llm.xxh import xxh64
    rnd = random.Random(5)
    parts = [rnd.randbytes(n) for n in [*range(0, 140), 511, 512, 513, 5000]]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    got = xxh64(np.frombuffer(b"".join(parts), np.uint8), starts, np.array(list(map(len, parts))), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


# ------------------------------------------------------------------ operator 9

def test_quality_rules(spark, sf, ran, rows):
    good = {i for i, q, t in labels() if q == 1 and not t and i is not None}
    ratios = log_ratios([r[1] for r in rows], [r[0] in good for r in rows], qualityrules.BUCKETS)
    got = ran("op9_quality_rules")[1]
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same([[r[c] for c in cols] for r in got], [(r[0], *counts(r[1])) for r in rows])
    means = {(r[0], len(spaced(r[1]))): sum(ratios[b] for b in g) / len(g) for r in rows if (g := grams(r[1], qualityrules.BUCKETS))}
    for r in got:
        if r["ratio"] is None:
            assert r["n_words"] == 0 and not r["kept"]
        else:
            assert math.isclose(r["ratio"], means[r["doc_id"], r["n_words"]], abs_tol=1e-4)
            assert r["kept"] == (not r["base_failed"] and r["ratio"] >= qualityrules.MIN_RATIO)


def test_quality_rules_tell_junk(spark):
    at = "/root/testdata/sf0.01"
    got = qualityrules.op9_quality_rules(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("not base_failed").collect()
    share = lambda x: sum(r["kept"] for r in x) / len(x)
    assert share([r for r in got if r["quality"] == 1]) > 0.98 and share([r for r in got if r["quality"] == 0]) < 0.1


# ------------------------------------------------------------------ operator 10

def test_secrets(spark, sf, ran, rows):
    got = ran("op10_secret_scan")[1]
    want = []
    for r in rows:
        s = secrets(r[1])
        want.append((r[0], *[sum(k == x for _, k, _ in s) for x in range(3)], hashlib.sha256(listed(s).encode()).hexdigest()))
    same([tuple(r)[:5] for r in got], want)
    assert sum(x[1] for x in want) >= 3
    base = [set(listed(secrets(r[1])).split(",")) - {""} for r in rows]
    spans = {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in got if r["doc_id"] not in (None, 7)}
    assert all(b <= spans[r[0]] for r, b in zip(rows, base, strict=True) if r[0] in spans)


def test_markov_model(spark):
    digests = [hashlib.sha256(str(i).encode()) for i in range(200)]
    samples = [(True, d.hexdigest()) for d in digests] + [(True, base64.b64encode(d.digest()).decode()) for d in digests] * 5
    samples += [(False, w) for w in "configuration parameter_name handler initialize connection_pool request response".split()] * 50
    model = secretscan.train(spark.createDataFrame(samples, "random boolean, token string"))
    df = spark.createDataFrame([(1, "the connection_pool_initialize_handler got 7f3a9c0e1b5d2846aa0c and x81vQ7bR4kLm2pW0Zy6H ok")], "id long, t string")
    found = secretscan.scan(df, "t", model, 0.0).select("markov.v").first()[0]
    assert found == ["7f3a9c0e1b5d2846aa0c", "x81vQ7bR4kLm2pW0Zy6H"]


def test_markov_alphabets(spark):
    """Planted tokens of every alphabet are found at the operator's threshold, ordinary ones are not."""
    import random
    rnd = random.Random(11)
    docs = read_documents(spark, "/root/testdata/sf0.01")
    model = secretscan.train(secretscan.labelled_samples(docs))
    planted = [(k, "".join(rnd.choice(a) for _ in range(40))) for k, a in secretscan.RANDOM.items() for _ in range(100)]
    planted += [("ordinary", x) for x in ("2353820953013749", "thatonblebleatther", "THATONBLEBLEATTHER", "theration_dieheit_reat2")]
    rows = spark.createDataFrame(planted, "k string, v string").withColumn("ratio", secretscan.log_ratio(F.col("v"), model)).collect()
    found = {k: [r["ratio"] > secretscan.MIN_RATIO for r in rows if r["k"] == k] for k in {r["k"] for r in rows}}
    assert not any(found.pop("ordinary"))
    assert {k: sum(x) / len(x) for k, x in found.items() if sum(x) < 0.8 * len(x)} == {}


def test_markov_beyond_base_span(spark):
    """A token that goes on around a base span is kept whole; one within is dropped."""
    token = "x81vQ7bR4kLm2pW0Zy6H" + "0123456789abcdef01234567" + "Kq9Zt4Xv"
    model = [2.0] * (len(secretscan.ALPHABET) * (len(secretscan.ALPHABET) + 1))
    df = spark.createDataFrame([(f"a {token} b token={'Zm9vYmFyYmF6cXV4MTIz'} c",)], "t string")
    r = secretscan.scan(df, "t", model).select("hex.s", "markov.v").first()
    assert (r["s"], r["v"]) == ([22], [token])


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"ä token={i:08x} 😀" for i in range(700))
    got = secretscan.base_spans(spark.createDataFrame([(text,)], "t string"), "t").select(secretscan.listing(list(secretscan.PATTERNS)).alias("x")).first()["x"]
    assert got == listed(secrets(text))


def test_a_hundred_thousand_secrets_in_one_text(spark):
    """Scan and mask stay near-linear in the matches of a text."""
    import time
    text = " ".join(f"token={i:08x} x81vQ7bR4kLm2pW0Zy6H{i:05d}" for i in range(50_000))
    model = [2.0] * (len(secretscan.ALPHABET) * (len(secretscan.ALPHABET) + 1))
    df = spark.createDataFrame([(text,), ("none",)], "t string")
    began = time.time()
    found = secretscan.scan(df, "t", model)
    spans = F.array_sort(F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in [*secretscan.PATTERNS, "markov"]]))
    got = found.select("t", spans.alias("spans")).select(F.size("spans").alias("n"), F.when(F.size("spans") > 0, secretscan.masked(F.col("t"), F.col("spans"))).alias("m")).collect()
    assert [r["n"] for r in got] == [100_000, 0] and got[0]["m"] == " ".join(["[SECRET] [SECRET]"] * 50_000) and got[1]["m"] is None
    assert time.time() - began < 240


# ------------------------------------------------------------------ pipeline

def test_stages_on_messy_rows(spark, sf, ran, rows):
    """Each stage alone: whole rows in, whole rows out, clashing columns kept."""
    docs = read_documents(spark, sf)
    cols = docs.columns
    plain = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in langid.stage(spark, docs, sf).collect()]
    assert set(got) <= set(plain) and len(got) < len(plain)
    kept = [tuple(r) for r in simhash.stage(spark, docs, sf).collect()]
    comp = components([fingerprint(r[1]) for r in plain])
    assert len(kept) == len(set(comp)) and set(kept) <= set(plain)
    first = {}
    for c, r in zip(comp, plain, strict=True):
        first.setdefault(c, []).append(math.inf if r[0] is None else r[0])
    assert sorted(math.inf if r[0] is None else r[0] for r in kept) == sorted(min(x) for x in first.values())
    hit = decontaminated([r[:2] for r in plain], benchmark(rows))
    same(decontam.stage(spark, docs, sf).collect(), [r for r, x in zip(plain, hit, strict=True) if not x[1]])
    clean = secretscan.stage(spark, docs, sf)
    assert clean.columns == cols
    found = {r["doc_id"]: r["spans"] for r in ran("op10_secret_scan")[1]}
    order = ["assign", "access", "hex", "markov"]
    for r in clean.collect():
        if r["doc_id"] in (73, 74):
            old = next(x for x in plain if x[0] == r["doc_id"])
            spans = [(int(s), order.index(k), int(e)) for k, s, e in (x.split(":") for x in found[r["doc_id"]].split(","))]
            assert r["text"] == masked(old[1], spans) and r["n_chars"] == len(r["text"]) and "[SECRET]" in r["text"]
    want = [r for r, x in zip(plain, mixed([(r[0], r[1], r[3]) for r in plain]), strict=True) for _ in range(x[4] // x[1] if x[1] else 0)]
    got = [tuple(r) for r in mixing.stage(spark, docs, sf).collect()]
    same([r for r in got if spaced(r[1])], want)


def test_pipeline(spark):
    """run() against plain Python, stage after stage."""
    at = "/root/testdata/sf0.001"
    docs = read_documents(spark, at)
    plain = [tuple(r) for r in docs.collect()]
    model = langid.learn(docs, langid.fold() != 0)
    plain = [r for r, x in zip(plain, langid.predict([r[1] for r in plain], model), strict=True) if not x[2]]
    plain.sort(key=lambda r: r[0])
    first = set()
    plain = [r for r, c in zip(plain, components([fingerprint(r[1]) for r in plain]), strict=True) if not (c in first or first.add(c))]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    plain = [r for r, x in zip(plain, decontaminated([r[:2] for r in plain], items), strict=True) if not x[1]]
    left = spark.createDataFrame(plain, docs.schema)
    texts = {r["doc_id"]: r["text"] for r in secretscan.stage(spark, left, at).collect()}
    assert all(texts[r[0]] == r[1] or "[SECRET]" in texts[r[0]] for r in plain)
    assert all((texts[r[0]] != r[1]) >= bool(secrets(r[1])) for r in plain)
    plain = [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in plain]
    want = [r for r, x in zip(plain, mixed([(r[0], r[1], r[3]) for r in plain]), strict=True) for _ in range(x[4] // x[1] if x[1] else 0)]
    same([r for r in corpus_pipeline.run(spark, at).collect() if spaced(r["text"])], want)


def test_pipeline_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "mixing"]
