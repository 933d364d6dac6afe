"""Every stage of the corpus pipeline on nulls, ties, repeats, empty tables and clashing names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import mixing, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", score double, size long, target string, taken int, component_id string, n_removed string, _key string"
BAD, GOOD = ["grumfa", "grumfb", "grumfx"], "river stone window garden paper simple music planet orange silver".split()


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = [GOOD[rng.integers(10)] + str(rng.integers(30)) for _ in range(60)]
        if i % 4 == 0:
            words[5:30:5] = [BAD[rng.integers(3)] for _ in range(5)]
        rows.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:]), "en", "abc"[i % 3]))
    rows += [(500, None, None, None), (501, "", "en", "a"), (None, "only words " * 8, None, "b"), (None, "other words here " * 7, "de", None)]
    rows += [(600, "shared line with quite a few words in it for all\n" + rows[1][1], "en", "a"), (7, rows[7][1], "en", "b"), (7, rows[7][1], "en", "b")]
    rows.append((700, "word " * 300_000, "en", "c"))
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def folder(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


LABELS = [(i, 1, int(i % 4 == 0)) for i in range(100)] + [(None, 1, 1), (3, None, None)]


def test_each_stage_keeps_the_columns_and_survives_odd_tables(spark, tmp_path, corpus):
    sf_dir = folder(spark, tmp_path, LABELS)
    wide = [(*r, 0.5, 1, "t", 2, "c", "n", "k") for r in corpus]
    for rows in (wide, []):
        docs = spark.createDataFrame(rows, EXTRA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns, name
                kept = out.select("score", "size", "target", "taken", "component_id", "n_removed", "_key").distinct().collect()
                assert [tuple(k) for k in kept] == ([(0.5, 1, "t", 2, "c", "n", "k")] if rows else []), name
            elif rows:
                assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows}
            else:
                assert out.count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path, corpus):
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.createDataFrame(corpus, DOCS), folder(spark, tmp_path, LABELS)).collect()}
    bad = {i for i in range(120) if i % 4 == 0}
    assert len(bad & kept) <= 2 and len({r[0] for r in corpus} - bad - kept) <= 1  # 100 labels train this model


def test_lines_and_copies_leave_one_each(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    rows = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert {500, 501} <= {r.doc_id for r in rows}  # texts without lines to remove stay
    assert next(r.text for r in rows if r.doc_id == 600) == "shared line with quite a few words in it for all"
    assert all(r.n_chars == len(r.text or "") for r in rows)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sum(r.doc_id == 7 for r in single) == 1 and sum(r.doc_id in (500, 501) for r in single) == 1
    assert sum(r.doc_id is None for r in single) == 2


def test_mixing_repeats_whole_documents_and_cuts_one(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, texts = {}, {t for _, t, *_ in corpus}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got.setdefault(r.source, []).append(r.text)
    plan = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, taken in got.items():
        assert abs(sum(map(words, taken)) - plan[source]) <= 2
        assert sum(t not in texts for t in taken) <= 1
    again = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert again == sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.mix_sources(spark, docs.orderBy(F.rand(1)), "").collect())


def test_fingerprints_match_the_engines_own_hash(spark):
    texts = ["One two three four", "a", "a b", " A\tB  c d e ", "", "é ß 日本 x y"]
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [r.h % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_packing_equals_plain_best_fit():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in np.minimum(2048, rng.gamma(1.2, 400, 3000) + 1)]
    fit, bins, places = packing.BestFit(2048, 64), {}, []
    for size in sizes:
        fitting = [(left, -b) for b, left in bins.items() if left >= size]
        if fitting:
            left, b = min((left for left, _ in fitting)), None
            b, offset = fit.place(size)
            assert bins[b] == left == 2048 - offset  # some bin with the least space that is enough
        else:
            if len(bins) >= 64 and size < 2048:
                full = min(bins.values())
            b, offset = fit.place(size)
            assert offset == 0 and b not in bins
            if len(bins) >= 64 and size < 2048:
                open_now = {x for stack in fit.bins.values() for x in stack}
                gone = [x for x in bins if x not in open_now]
                assert len(gone) == 1 and bins.pop(gone[0]) == full  # the fullest closes
            left = 2048
        if left - size:
            bins[b] = left - size
        else:
            bins.pop(b, None)
        places.append((b, offset, size))
    spans = {}
    for b, offset, size in places:
        assert spans.get(b, 0) == offset
        spans[b] = offset + size
    assert max(spans.values()) <= 2048
