"""Queries over the driver's tables that apply each operator with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import ann, chat, html_text, line_dedup, mixing, packing, simhash, toxicity, url_filter, vector_dedup

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Site names that are blocked where no rule fits.
BLOCKED_SITES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCKED_SITES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS, MAX_EPOCHS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return deduped.select("doc_id", "n_lines", "n_removed", "text")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(_table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_nearest": op10_nearest,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (
            SELECT page_id, host, path, h || p AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
            FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'adult-x', 'ads-track'])
                                      THEN 'block' ELSE 'allow' END) AS verdict
        FROM m WHERE k = 1""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS o, md5(coalesce(text, '')) AS tie
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
            FROM d GROUP BY source
        ), c AS (
            SELECT *, (3 * source_size)::DOUBLE AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s
        ), l AS (
            SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                   sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM c
        ), lv AS (SELECT remaining, weights FROM l WHERE NOT cap * weights <= remaining * w ORDER BY k LIMIT 1),
        t AS (
            SELECT source, source_size,
                   CASE WHEN cap * weights <= remaining * w THEN cap
                        ELSE least(cap, (SELECT remaining FROM lv) * w / (SELECT weights FROM lv)) END AS target
            FROM l
        ), p AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t
        ), q AS (
            SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE greatest(0, floor(target - whole * source_size)) END::BIGINT AS rest FROM p
        ), e AS (
            SELECT doc_id, size, source_size, target, whole, rest,
                   sum(size) OVER (PARTITION BY d.source ORDER BY o, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
            FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
        )
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM e""",
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL
        ), w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
        k AS (SELECT doc_id, no, array_to_string(words, ' ') AS k, words FROM w WHERE len(words) > 0),
        c AS (SELECT k, any_value(words) AS words, min((doc_id, no)) AS place, row_number() OVER (ORDER BY k) AS id FROM k GROUP BY k),
        t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS t FROM c WHERE len(words) >= 5),
        n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id GROUP BY ALL),
        g AS (SELECT DISTINCT p.b AS id FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN c e ON e.id = a JOIN c f ON f.id = b
              WHERE e.place < f.place AND p.k * 5 >= (x.n + y.n - p.k) * 4),
        r AS (SELECT k.doc_id, k.no FROM k JOIN c USING (k) WHERE (k.doc_id, k.no) <> c.place OR c.id IN (SELECT id FROM g)),
        s AS (SELECT l.doc_id, count(*) AS n_lines, count(r.no) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (r.no IS NULL), '') AS text
              FROM l LEFT JOIN r USING (doc_id, no) GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, s.text FROM documents d LEFT JOIN s USING (doc_id)""",
    "op8_chat": r"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS no FROM m),
        q AS (SELECT conv_id, turn, no, len(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+')) - len(replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '>', '')) AS level,
                     regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS raw FROM l),
        o AS (SELECT *, level = 0 AND NOT (regexp_matches(raw, '^[ \t]*(On\b.*\bwrote:|Am\b.*\bschrieb.*:|Le\b.*\ba écrit ?:|El\b.*\bescribió:)[ \t]*$')
                     AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY no), 0) > 0) AS own, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS text FROM q),
        x AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (own), ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text,
                     count(*) FILTER (level > 0) AS n_quoted FROM o GROUP BY ALL),
        b AS (SELECT *, (level <> lag(level, 1, -1) OVER w OR text = '' OR lag(text, 1, '') OVER w = '')::INT AS broken FROM o WINDOW w AS (PARTITION BY conv_id, turn ORDER BY no)),
        u AS (SELECT *, sum(broken) OVER (PARTITION BY conv_id, turn ORDER BY no) AS run FROM b),
        f AS (SELECT * FROM u WHERE text <> ''),
        p AS (SELECT conv_id, turn, level, 0 AS whole, text FROM f
              UNION SELECT conv_id, turn, level, 1, string_agg(text, ' ' ORDER BY no) FROM f GROUP BY conv_id, turn, level, run
              UNION SELECT conv_id, turn, level, 2, string_agg(text, ' ' ORDER BY no) FROM f GROUP BY conv_id, turn, level),
        h AS (SELECT a.conv_id, a.turn, a.level, a.whole, max(b.turn) AS source FROM p a JOIN p b ON b.level = 0 AND a.level > 0 AND a.conv_id = b.conv_id AND a.text = b.text AND b.turn < a.turn GROUP BY ALL),
        k AS (SELECT conv_id, turn, source FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, whole DESC, source DESC) = 1),
        t AS (SELECT conv_id, turn, coalesce(source, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS parent, source IS NOT NULL AS linked FROM m LEFT JOIN k USING (conv_id, turn)),
        r AS (SELECT conv_id, turn, turn AS root, 0::BIGINT AS depth FROM t WHERE parent IS NULL
              UNION ALL SELECT t.conv_id, t.turn, r.root, r.depth + 1 FROM t JOIN r ON t.conv_id = r.conv_id AND t.parent = r.turn)
        SELECT m.conv_id, m.turn, m.role, x.text, t.parent AS parent_turn, r.root AS root_turn, r.depth, t.linked, x.n_quoted::INT AS n_quoted
        FROM m JOIN x USING (conv_id, turn) JOIN t USING (conv_id, turn) JOIN r USING (conv_id, turn)""",
}
