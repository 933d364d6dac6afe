import random
import time

import pytest

from auditloom.llm import html_text


def table_length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


@pytest.mark.parametrize("bits", [1 << 26, 30])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_text, "TABLE_BITS", bits)
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = html_text.shared_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and all(a[i] in rest for i in found) and len(found) == table_length(a, b)
    assert html_text.shared_lines([1, 2, 1], [2, 1]) == [1, 2] and html_text.shared_lines([], [1]) == []


def test_scan_is_linear_in_broken_pages():
    for page in ("<a " * 350_000, '<a "' * 250_000 + ">", "<![CDATA[ >" * 90_000, "<!-- >" * 170_000, "<" * 1_000_000):
        began = time.time()
        html_text.parse(page)
        assert time.time() - began < 5
    assert [b.text for b in html_text.parse("<p>a<!-- b > c -->d<![CDATA[x]]>e < f")] == ["ade < f"]


def test_pages_with_odd_rows(spark):
    long = "<body><p>" + "word " * 200_000 + "</p></body>"
    rows = [(1, "http://a.org/x", long, "t"), (1, "http://a.org/x", long, "t"), (None, None, None, None), (2, "nothing", "", "u"), (3, "http://a.org/y", "<p>x", "k")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, key string")).collect()
    assert len(got) == 5 and sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 999_999), (1, 999_999), (2, 0), (3, 1)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
