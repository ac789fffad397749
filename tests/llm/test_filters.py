"""Quality rules, URL filter, mixing and WARC."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, quality_rules, url_filter, warc

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules


def counts(text):
    t = text or ""
    words = WORD.findall(t)
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), sum(a == b for a, b in zip(words, words[1:]))


def test_counts_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.op7_quality_rules(spark, FOLDER).collect():
        want = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_counts_of_odd_rows(odd):
    got = sorted(tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.assess(odd).collect())
    assert got == sorted(counts(r["text"]) for r in odd.collect())


def test_odd_and_no_rows_keep_their_columns(odd, none):
    kept = quality_rules.keep_clean(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert quality_rules.keep_clean(none).collect() == []


def concentrate(x, steps=quality_rules.STEPS):
    """The same estimate with numpy and exact quantiles."""
    d, floor = x.shape[1], np.diag([v**2 for v in quality_rules.FLOOR.values()])
    best = None
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    for mean, spread in ((mid, (high - low) / 1.349), (x.mean(0), x.std(0))):
        cov = np.diag(spread**2) + floor
        for _ in range(steps):
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[d2 <= np.quantile(d2, quality_rules.SUPPORT, method="inverted_cdf")]
            mean, cov = inner.mean(0), np.cov(inner.T, bias=True) * quality_rules.CONSISTENCY + floor
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), mean, cov)
    _, mean, cov = best
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_estimate_agrees_with_numpy_and_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 6)) * [0.5, 0.2, 0.4, 0.2, 0.2, 0.2]
    x[:120] += 8
    names = list(quality_rules.AXES)
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{n} double" for n in names))
    est = quality_rules.robust_estimates(df)
    got = df.join(est, "grp").select(*names, quality_rules.squared_distance().alias("d2")).collect()
    want = dict(zip(map(tuple, np.round(x, 9)), concentrate(x)))
    d2 = np.array([r["d2"] for r in got])
    exact = np.array([want[tuple(np.round([r[n] for n in names], 9))] for r in got])
    assert np.allclose(d2, exact, rtol=0.05)
    outer = np.array([r[names[0]] > 4 for r in got])
    assert (d2[outer] > quality_rules.CUTOFF).all() and (d2[~outer] <= quality_rules.CUTOFF).all()


def test_groups_of_any_size_are_judged(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for size in (1, 5, 30, 59, 60, 61, 200):
        for k in range(size):
            text = " ".join(str(w) + str(rng.integers(1000)) for w in rng.choice(words, rng.integers(40, 120)))
            rows.append((len(rows), text, "en", f"s{size}", True))
        rows.append((len(rows), " ".join(f"#w{k}## $$" for k in range(60)), "en", f"s{size}", False))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fine boolean")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.assess(df).collect()}
    assert kept == {r[0]: r[4] for r in rows}


def test_long_texts_are_counted_whole(spark):
    text = " ".join(f"w{k} w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    got = quality_rules.assess(df).first()
    assert (got["n_words"], got["n_again"], got["n_repeat_words"]) == (400_000, 200_000, 0)


def test_junk_goes_and_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_rules.op7_quality_rules(spark, folder).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] >= 0.995 and share[0] <= 0.1


# URL filter


def test_url_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    df = url_filter.op9_url_filter(spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({url_filter.SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


ODD_URLS = [
    ("HTTP://A.Example.NET/en/x?utm_source=q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net", "a.example.net", "", None, "allow"),
    ("http://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://example.com/de/a://b", "example.com", "/de/a://b", "example.com/de/", "block"),
    ("//example.com/de/", "", "", None, "allow"),
    ("x://É.org/fr/É", "É.org", "/fr/É", "org/fr/", "allow"),
    ("a://?q", "", "", None, "allow"),
    ("http://listed.org/a/?b=2&a=1&utm_x=3", "listed.org", "/a/", None, "block"),
    ("https://LISTED.org/a?a=1&b=2#z", "listed.org", "/a", None, "block"),
    ("https://listed.org/A?a=1&b=2", "listed.org", "/A", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


@pytest.mark.parametrize("n_blocks", [1, None])
def test_odd_urls(spark, n_blocks):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[0][0], "x", "y")], "page_id long, url string, canon string, listed string")
    listed = spark.createDataFrame([("http://listed.org/a?a=1&b=2",), (None,), ("no url",)], "url string")
    got = url_filter.filter_urls(pages, listed, n_blocks=n_blocks).collect()
    assert len(got) == len(ODD_URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == ODD_URLS[r["page_id"]][1:]
    assert url_filter.filter_urls(pages.limit(0), listed.limit(0)).collect() == []


def test_longest_rule_wins(spark):
    rules = (("block", "b.c", "/"), ("allow", "a.b.c", "/"), ("block", "c", "/longer/"))
    df = spark.createDataFrame([("a.b.c", "/longer/x"), ("a.b.c", "/x"), ("b.c", "/longer/"), ("b.c", "/")], "h string, p string")
    got = [r[0]["verdict"] for r in df.select(url_filter.matching_rule(F.col("h"), F.col("p"), rules)).collect()]
    assert got == ["block", "allow", "block", "block"]


# Mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


def test_targets_and_taken_words(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    words = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in docs.collect()}
    got = mixing.op5_mixing(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op5_mixing(spark, folder).collect()))
    sizes = collections.Counter()
    for s, n in words.values():
        sizes[s] += n
    target, taken, largest = filled(sizes), collections.Counter(), collections.Counter()
    assert len(got) == len(words)
    for r in got:
        s, n = words[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["taken"] in (0, n, 2 * n)
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_targets_with_full_and_empty_sources(spark):
    rows = [("a", 10), ("b", 1), ("c", 500), (None, 3), ("d", 0), ("é", 40)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(dict(rows)))


def test_expected_copies_are_kept(spark):
    rows = [((i, 1, "s", 1 + i % 7), "s", 1 + i % 7, 0.3, 700) for i in range(700)]
    schema = "key struct<doc_id:bigint,nth:bigint,source:string,size:bigint>, source string, size long, p double, n_docs long"
    df = spark.createDataFrame(rows, schema)
    mass = sum(r[2] for r in rows)
    first = collections.Counter()
    for seed in range(6):
        got = mixing.pivotal_copies(df, fan_in=8, seed=seed).collect()
        assert len(got) == 700
        assert abs(sum(r["extra"] * r["key"]["size"] for r in got) - 0.3 * mass) <= 7
        for r in got:
            first[r["key"]["size"]] += r["extra"]
    for size in range(1, 8):
        assert abs(first[size] / 600 - 0.3) < 0.1


def test_mix_of_odd_and_no_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count()
    n = got.agg(F.sum("copies")).first()[0]
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == n
    assert mixing.apply_mix(none).collect() == [] and mixing.mix(none).collect() == []


# WARC


def test_warc_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    df = warc.op10_warc(spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({warc.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_round_trip_of_odd_pages(spark):
    html = ["<p>é🎉</p>", "", None, "x" * 300_000, "\r\n\r\nWARC/1.1\r\n", "<p>é🎉</p>", "<p>é🎉</p>"]
    rows = [(i, f"http://a/{i}\r\nX: y", h, "n") for i, h in enumerate(html)] + [(None, None, "<p>é🎉</p>", "n"), (None, None, "alone", "n"), (0, "again", "<p>é🎉</p>", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.round_trip(df, archive_bytes=500).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_members_are_read_in_chunks_and_are_plain_gzip():
    records = [warc.record_bytes(i, f"http://a/{i}", b"x" * (i * 977), "response", None) for i in range(9)]
    raw = b"".join(map(warc.gzip_member, records))
    assert gzip.decompress(raw) == b"".join(records)
    for chunk in (1, 7, 1 << 16):
        got = list(warc.records(io.BytesIO(raw), chunk))
        assert [(h["warc-record-id"], n) for h, n in got] == [(f"<urn:page:{i}>", i * 977) for i in range(9)]


def test_damage_is_found():
    record = warc.record_bytes(1, "http://a/", b"payload", "response", None)
    raw = warc.gzip_member(record)
    for bad in (raw[:-3], raw + b"junk", warc.gzip_member(record.replace(b"payload", b"pay1oad")), warc.gzip_member(record[:-5]), warc.gzip_member(record + b"x")):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(bad)))
    assert zlib.decompress(raw, 31) == record
