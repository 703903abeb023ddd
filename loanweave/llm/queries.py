"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.llm import (
    centroids, collocations, fingerprint, license_scan, line_dedup, mixing, near_dup, neighbours,
    ngram_join, packing, quality, token_files, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, path, with_ids=False)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


# Base32 of a SHA-1: 40 hex digits are 8 groups of 20 bits, 4 letters each.
SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
b AS (SELECT page_id, n, x, array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)
        for i in range(32)], '') AS digest FROM d),
g AS (SELECT x, max(page_id) AS leader FROM d GROUP BY x)
SELECT b.page_id, b.n::BIGINT AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN b.page_id = g.leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id <> g.leader THEN g.leader END AS refers_to
FROM b JOIN g USING (x)
"""


@query
def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"), least=1).select(
        "doc_id", "source", "lang", "removed_lines", "text")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


SQL["op9_mixing"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, source, size, -ln(u) / weight AS key,
        row_number() OVER (ORDER BY doc_id) AS line
    FROM (SELECT doc_id, source,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            CASE WHEN coalesce(length(text), 0) = 0 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE
                + 0.75::DOUBLE * length(regexp_replace(text, '[^\p{L} ]', '', 'g')) / length(text) END AS weight,
            (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
-- Sources that reach their limit first come first; level if exactly the earlier ones are at it.
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
            / (sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight DESC, source DESC)) AS level,
        3.0::DOUBLE * source_size / weight AS ratio
    FROM s WHERE source_size > 0
    WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM r WHERE level * weight < cap),
t AS (SELECT source, source_size, target,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
    FROM (SELECT s.source, source_size, least(3.0::DOUBLE * source_size, coalesce(level, 0) * weight) AS target FROM s, l)),
q AS MATERIALIZED (SELECT d.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
        row_number() OVER (PARTITION BY d.source ORDER BY key, line) AS k
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
walk AS (
    SELECT source, 0::BIGINT AS k, 0::DOUBLE AS done, false AS took, false AS stop FROM q WHERE k = 1
    UNION ALL
    SELECT q.source, q.k, CASE WHEN rest - done > 0.0005::DOUBLE * target AND done + size <= rest THEN done + size ELSE done END,
        rest - done > 0.0005::DOUBLE * target AND done + size <= rest, rest - done <= 0.0005::DOUBLE * target
    FROM walk JOIN q ON q.source IS NOT DISTINCT FROM walk.source AND q.k = walk.k + 1 WHERE NOT stop),
ends AS (SELECT source, max(done) AS done FROM walk GROUP BY source),
late AS (SELECT q.source, arg_min(q.k, abs(ed + size - rest) * 1e6 + q.k * 1e-3) AS k, min(abs(ed + size - rest)) AS off, any_value(rest - ed) AS gap
    FROM walk JOIN q ON q.source IS NOT DISTINCT FROM walk.source AND q.k = walk.k
    JOIN (SELECT source AS es, done AS ed FROM ends) ON es IS NOT DISTINCT FROM q.source
    WHERE NOT took AND walk.k > 0 GROUP BY q.source),
extra AS (SELECT source, k FROM walk WHERE took
    UNION ALL SELECT source, k FROM late WHERE off < gap)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    epochs + (e.k IS NOT NULL)::BIGINT AS times,
    size * (epochs + (e.k IS NOT NULL)::BIGINT) AS taken
FROM q LEFT JOIN extra e ON q.source IS NOT DISTINCT FROM e.source AND q.k = e.k
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _centroid_rounds(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c0, c1, ... one after the other."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (
    SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c USING (j) GROUP BY v.r, c.k)
    GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT a.m.k AS k, v.j, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM a{i} a JOIN v USING (r) GROUP BY a.m.k, v.j) s USING (k, j))""")
    return ",".join(parts)


SQL["op12_centroids"] = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: floor(256 * x)::BIGINT) AS q
    FROM e WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM rows),
c0 AS MATERIALIZED (SELECT k - 1 AS k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM (
    SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) AS k FROM rows) WHERE k <= 40),
{_centroid_rounds(5).strip()},
last AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c5 GROUP BY k)
SELECT rows.vec_id, a.m.k::INT AS cluster, a.m.d AS distance,
    (sum(a.m.d) OVER (PARTITION BY a.m.k))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
    last.h AS centroid_sha256
FROM a5 a JOIN rows USING (r) JOIN last ON last.k = a.m.k
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2),
        lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS words)) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
cuts AS (SELECT c.*, l.f AS l, r.f AS r, k, 2000000 * a // (l.f + r.f) AS score
    FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, words - n + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS n FROM c WHERE words > 2))
    GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


SQL["op11_ngram_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS t FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS MATERIALIZED (SELECT a, b FROM (
        SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.r < y.r GROUP BY x.r, y.r)
    JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS x FROM w UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.x),
c AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.x GROUP BY reach.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w JOIN c ON c.r = w.r LEFT JOIN n ON n.r = w.r
"""
