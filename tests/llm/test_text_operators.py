"""Small brute-force checks of the text operators, with nulls, empties, ties, repeats and extra columns."""

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import html_text, line_dedup, mixing, packing, simhash, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(40)) for _ in range(n))


def test_simhash_groups_match_brute_force(spark):
    rng, rows = np.random.default_rng(0), [(0, None, "a"), (1, "", "b"), (2, "One", "c"), (3, " ONE\t", "d"), (None, "two words", "e")]
    for i in range(10, 90):
        base = random_text(rng, 400)
        rows += [(i * 10, base, "x"), (i * 10 + 1, base.replace(base.split()[7], "changed"), "x"), (i * 10 + 2, base, "y")]
    got = simhash.simhash_groups(frame(spark, rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert fps[0] == fps[1] == 0 and fps[2] == fps[3]
    assert all(fps[d] == simhash.fingerprint(t or "") for d, t, _ in rows)
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            root[find(a)] = find(b)
    low = defaultdict(list)
    for i in ids:
        low[find(i)].append(i)
    known = {i: min((x for x in m if x is not None), default=None) for m in low.values() for i in m}
    assert all(r.component_id == known[r.doc_id] for r in got)
    assert simhash.simhash_groups(frame(spark, [], "doc_id long, text string")).count() == 0


def test_pipeline_keeps_one_row_of_each_simhash_group(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    a, b, c, d, e = (random_text(rng, 400) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (5, d), (5, e), (5, e), (6, e), (4, d), (None, None), (8, "")]
    docs = frame(spark, [(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == 6 and set(found) == {(None, a), (None, b), (7, c), (4, d), (5, e), (8, "")}


def test_simhash_grid_finds_every_link(spark):
    rng = np.random.default_rng(1)
    made = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 200)}
    for fp in list(made)[:60]:
        for bits in rng.integers(0, 64, (3, 2)):
            made.add(int(np.int64(fp) ^ np.int64(np.uint64(1) << np.uint64(bits[0])) ^ np.int64(np.uint64(1) << np.uint64(bits[1]))))
    from auditloom.llm.common import connected_components

    nodes = connected_components(simhash.links(frame(spark, [(x,) for x in made], "fp long"))).collect()
    group = {r.node: r.component for r in nodes}
    for a, b in itertools.combinations(made, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
            assert group[a] == group[b]


def test_url_rules_and_edge_cases(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = ["http://a.EXAMPLE.net/en/x?y", "https://net/", "http://x.net", "http://example.com/de/", "q://b.org/fr/1#t", "http://spam.org/", None, "nothing", "http://notexample.com/de/", ""]
    pages = frame(spark, [(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules, ["spam"]).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[0].host == "a.example.net" and got[0].path == "/en/x" and got[6].host == "" and got[2].path == ""
    assert url_filter.filter_urls(pages.where("false"), rules, ["spam"]).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).selectExpr("cast(id as string) as key")
    cascade = url_filter.build_cascade(universe.where("cast(key as int) % 7 = 0"), universe)
    wrong = universe.where(cascade.contains(universe.key) != (universe.key.cast("int") % 7 == 0))
    assert wrong.count() == 0 and len(cascade.levels) > 1


def test_cascade_splits_lists_past_the_level_bound(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVEL_BITS", 512)
    universe = spark.range(2000).selectExpr("cast(id as string) as key")
    cascade = url_filter.build_cascade(universe.where("cast(key as int) % 7 = 0"), universe)
    assert isinstance(cascade, url_filter.SplitCascade) and max(x.bits for x in cascade.levels) <= 512
    found = universe.select("key", cascade.contains(universe.key).alias("found"))
    assert found.where(found.found != (found.key.cast("int") % 7 == 0)).count() == 0


def test_html_blocks():
    page = '<body><div class="menu">M</div><article><header><h1>T &amp; x</h1></header><p class="ad">buy<p>one<br>two&nbsp;3<div class="comments">c<div>d</div></div></article><p>out</p></body>'
    assert [b.text for b in html_text.parse(page) if b.inside] == ["T & x", "one two 3"]
    assert html_text.parse("") == [] and [b.text for b in html_text.parse("a < b <b>c</b><script>x</p>")] == ["a < b c"]


def test_html_differencing_removes_shared_lines(spark):
    page = lambda n: f"<body><div>Site name</div><div>{n} own</div><div>more {n}</div><div>still {n}</div><div>Imprint</div></body>"
    rows = [(i, f"http://h.org/en/{i}", page(i), i) for i in range(6)] + [(9, None, None, 0), (10, "http://z.org/", page(7), 1)]
    got = {r.page_id: r.text for r in html_text.extract_text(frame(spark, rows, "page_id long, url string, html string, text long")).collect()}
    assert got[3] == "3 own\nmore 3\nstill 3" and got[9] == "" and got[10].startswith("Site name")


def test_html_differencing_removes_a_template_of_most_lines(spark):
    page = lambda *own: "<body>" + "".join(f"<div>{x}</div>" for x in ("Site", "Offer", *own, "Imprint", "Terms", "Contact")) + "</body>"
    urls = [(i, f"http://h.org/a/{i:02}", page(f"text {i}", f"more {i}", f"still {i}")) for i in range(8)]
    urls += [(20 + i, f"http://h.org/a/03/{i:02}", urls[3][2]) for i in range(12)]  # copies of page 3, next to it
    urls += [(40, "http://h.org/a/05/x", page("text 5", "more 5", "still 5", "dated"))]  # a near copy of page 5
    urls += [(50 + i, f"http://two.org/{i}", page(f"only {i}")) for i in range(2)] + [(60, "http://one.org/", page("lone")), (61, "http://one.org/b", page("lone"))]
    got = {r.page_id: r.text for r in html_text.extract_text(frame(spark, urls, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}\nmore {i}\nstill {i}" for i in range(8))
    assert all(got[20 + i] == got[3] for i in range(12)) and got[40] == "text 5\nmore 5\nstill 5\ndated"
    assert got[50] == "only 0" and got[51] == "only 1" and got[60] == got[61] and got[60].startswith("Site\nOffer\nlone")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [random_text(rng, int(n)) for n in rng.integers(1, 700, 120)] + ["", None, "é<|endoftext|>  x\n\n y", random_text(rng, 3000)]
    docs = frame(spark, [(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    got = packing.pack_documents(docs).collect()
    tok, pieces, places = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(pieces[i]) == 1 or all(r.length == 2048 for r in pieces[i] if r.piece))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= 1.08 * total / 2048 + 1
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (i % 50 + 1), s, 1) for i, s in enumerate("aaaaaaaaabbc" * 40)] + [(9000, None, "a", 1), (9001, "x y", None, 2), (None, "", "b", 3), (3, "w " * 4, "a", 1)]
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string, target long")).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        b = by[r.source]
        b[0], b[1], b[2] = b[0] + r.size, b[1] + r.taken, r.target
    assert all(abs(t - target) <= 2 and target <= 3 * size for size, t, target in by.values())
    assert abs(sum(b[2] for b in by.values()) - sum(b[0] for b in by.values())) < 1e-6


def test_line_dedup_matches_brute_force(spark):
    rng, rows = np.random.default_rng(4), [(0, None, 1), (1, "", 2), (2, "short line\nshort line", 3)]
    pool = [random_text(rng, int(n)) for n in rng.integers(5, 60, 30)]
    for i in range(3, 60):
        lines = []
        for _ in range(4):
            words = pool[rng.integers(len(pool))].split()
            for _ in range(int(rng.integers(0, 3))):
                words[rng.integers(len(words))] = "edit" + str(rng.integers(1000))
            lines.append(" ".join(words).title() if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(lines), 4))
    rows.append(rows[5])
    got = line_dedup.dedup_lines(frame(spark, rows, "doc_id long, text string, n_lines long"))
    seen, want = [], {}
    for i, text, _ in rows[:-1]:
        kept = []
        for line in (text or "").split("\n"):
            w = re.findall(r"[^\x20\x09-\x0d]+", line.lower())
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if not (s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)):
                kept.append(line)
            if s:
                seen.append(s)
        want[i] = None if text is None else "\n".join(kept)
    rows_got = got.collect()
    assert len(rows_got) == len(rows) and all(r.text == want[r.doc_id] for r in rows_got)
    assert line_dedup.dedup_lines(frame(spark, [], "doc_id long, text string")).count() == 0


def test_line_dedup_removes_repeated_short_lines(spark):
    import corpus_pipeline

    five = "one two three four five"
    rows = [(1, "Yes\n\nAll rights reserved.\nyes\n" + five), (2, "all  RIGHTS reserved.\n\nreserved. rights all\none two three four"), (3, "\tyes "), (4, f"one two three four\n{five}\nfive"), (None, "five")]
    docs = frame(spark, [(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, short_lines=True).collect()}
    assert got == {
        1: ("Yes\n\nAll rights reserved.\n" + five, 5, 1), 2: ("\nreserved. rights all\none two three four", 4, 1), 3: ("", 1, 1), 4: ("", 3, 3), None: ("five", 1, 0),
    }
    assert {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {1, 2, None}


def test_line_dedup_of_odd_rows(spark):
    long, ten = "w " * 300_000, "one two three four five six seven eight nine ten"
    rows = [(None, f"{ten}\n{long}", "k"), (None, f"{ten} eleven\nown words of this one", "k"), (3, long, "k"), (3, long, "k"), (4, f"\t{ten.upper()}  \r\n\x0b\n", "k"), (5, "\n".join([ten] * 3), "k")]
    docs = frame(spark, [(*r, [1], "x", 7) for r in rows], "doc_id long, text string, key string, removed array<int>, _key string, n_lines int")
    got = line_dedup.dedup_lines(docs, short_lines=True)
    assert got.columns == ["doc_id", "text", "key", "removed", "_key", "n_lines", "n_removed"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.key == "k" and r.removed == [1] and r._key == "x" for r in found)
    by = {(r.doc_id, r.n_lines): r.text for r in found}
    assert by[3, 1] == "" and by[4, 3] == "\x0b\n" and by[5, 3] == ""  # nothing of a repeated line stays
    firsts = [r.text for r in found if r.doc_id is None]
    assert sorted(len(t.split("\n")) for t in firsts) in ([1, 2], [2, 2])  # the two head lines match; the one that comes later goes


def test_toxicity_learns_stems(spark):
    rng, rows, labels = np.random.default_rng(5), [], []
    for i in range(300):
        words = random_text(rng, 60).split()
        if i % 3 == 0:
            words[5:8] = ["grumf" + "abcdefgh"[rng.integers(8)] + "xyz"[rng.integers(3)] for _ in range(3)]
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, None, 0.0), (1001, "grumfq grumfvw", 0.0), (1001, "grumfq grumfvw", 0.0)]
    labels += [(1, None), (None, 1)]
    got = toxicity.score_toxicity(frame(spark, rows, "doc_id long, text string, score double"), frame(spark, labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and np.mean([(r.doc_id % 3 == 0) == bool(r.predicted) for r in held]) > 0.9


def test_toxicity_reads_long_runs_and_single_windows_whole():
    run = "".join(chr(0x4E00 + i) for i in range(1000))
    scores = np.zeros(1 << 18, np.float32)
    for n in (39, 40, 41, 42, 43, 44, 79, 80, 81, 82, 1000):
        raw = f"<{run[:n]}>"
        made = {x[i : i + k] for x in toxicity.words_of(run[:n]) for k in (3, 4, 5) for i in range(len(x) - k + 1)}
        assert made == {raw[i : i + k] for k in (3, 4, 5) for i in range(len(raw) - k + 1)}
    scores[zlib.crc32(run[700:705].encode()) % len(scores)] = 1
    assert toxicity.text_odds(run, scores, 0.0, {}) > toxicity.text_odds(run[:40], scores, 0.0, {}) == 0
    bad = " ".join(f"grumf{i}x" for i in range(96))
    scores[toxicity.grams("<grumf", len(scores))] = 1
    alone = toxicity.text_odds(bad, scores, -1.0, {})
    assert all(toxicity.text_odds(bad + " clean" * 96 * n, scores, -1.0, {}) >= alone > -0.9 for n in (1, 10, 200))


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "x\n\n y", "", "日本 語", "it's <|endoftext|>"])
def test_encoder_equals_tokenizer(text):
    encode = packing.encoder(packing.default_tokenizer())
    assert encode(text) == np.array(encode.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_line_dedup_looks_for_odd_white_space_once(spark, monkeypatch):
    looked, odd = [], line_dedup._odd
    monkeypatch.setattr(line_dedup, "_odd", lambda text: looked.append(1) or odd(text), raising=False)
    long = "one two three four five six seven"
    plain = [(1, f"{long}\nalpha"), (2, f"beta\n{long}"), (3, None), (4, "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, plain, "doc_id long, text string")).collect()}
    assert got == {1: (plain[0][1], 0), 2: ("beta", 1), 3: (None, 0), 4: ("", 0)} and len(looked) == 1
    for gap in ("  ", "\t\x0b"):  # a single odd text, whichever it is, is found again in every pass
        for at in (0, 1):
            rows = [(i, t.replace("four ", "four" + gap) if i == at + 1 else t) for i, t in plain]
            got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows, "doc_id long, text string")).collect()}
            assert got == {1: (rows[0][1], 0), 2: ("beta", 1), 3: (None, 0), 4: ("", 0)}, (gap, at)


def test_line_tokens_are_written_out_in_blocks_without_nulls(spark):
    whole = line_dedup.BLOCK * line_dedup.BLOCKS + line_dedup.SHINGLE - 1  # words of the longest line that blocks serve
    sizes = [0, 1, 4, 5, 6, 19, 20, 21, 22, whole - 1, whole, whole + 1, whole + 40]
    rows = [(i, " ".join(f"w{j % 300}" for j in range(size))) for i, size in enumerate(sizes)] + [(99, "a b c d e a b c d e a b c d e")]
    made = line_dedup.with_tokens(frame(spark, rows, "id long, line string"))
    assert not made.schema["tokens"].dataType.containsNull  # arrays that may hold nulls are sorted as objects
    run = ", ".join(f"xxhash64(w[i + {k}])" for k in range(5))
    each = f"array_sort(array_distinct(transform(filter(sequence(0, size(w)), i -> i + 5 <= size(w)), i -> xxhash64({run})))) AS tokens"
    want = frame(spark, rows, "id long, line string").selectExpr("id", "split(line, ' ') AS w").selectExpr("id", each)
    got = {r.id: r.tokens for r in made.collect()}
    assert got == {r.id: r.tokens for r in want.collect()}
    assert [len(got[i]) for i in range(len(sizes))] == [min(max(0, size - 4), 300) for size in sizes]
    assert len(got[99]) == 5
