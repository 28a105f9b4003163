"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op9_external_shuffle")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import sharding

    return sharding.digests(table(spark, sf_dir, "documents"))


@query(
    "op10_warc_revisits",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS original FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, h.payload_digest AS payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM h LEFT JOIN o ON h.payload_digest = o.payload_digest""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import warc

    return warc.digests(table(spark, sf_dir, "pages"))


@query(
    "op6_winnowing",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import decontaminate

    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_multiset_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import multiset

    return multiset.digests(table(spark, sf_dir, "documents"))


@query(
    "op3_line_chunks",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS o, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
m AS (SELECT r, o, l, list_filter(range(1, len(l) + 1), lambda i: trim(l[i], ' ' || chr(9) || chr(13)) <> '') AS p FROM d WHERE text IS NOT NULL),
c AS (SELECT r, o, p[k] AS a, p[k + 1] AS b, array_to_string(l[p[k]:p[k + 1]], chr(10)) AS t FROM (SELECT *, unnest(range(1, len(p))) AS k FROM m)),
w AS (SELECT t, min(o) AS owner FROM c GROUP BY 1),
f AS (SELECT r, t, arg_min(b, a) AS b1 FROM c GROUP BY 1, 2),
g AS (SELECT c.r AS r, list_distinct(flatten(list(range(c.a, c.b + 1)))) AS gone FROM c JOIN w ON c.t = w.t JOIN f ON c.r = f.r AND c.t = f.t WHERE owner < o OR b1 < c.a GROUP BY 1),
k AS (SELECT d.doc_id AS doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END, '') AS kept
  FROM d LEFT JOIN g ON d.r = g.r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM k""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import linechunks

    return linechunks.digests(table(spark, sf_dir, "documents"))


@query(
    "op1_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
  UNION ALL SELECT r, '/' || t FROM d WHERE len(w) = 0),
n AS (SELECT r, count(*) AS c, md5(string_agg(g, '|' ORDER BY g)) AS key FROM s GROUP BY 1),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE shared >= 0.8 * (a.c + b.c - shared) - 1e-9),
f(r, o) AS (SELECT r, r FROM d UNION SELECT e.y, f.o FROM f JOIN e ON e.x = f.r),
c AS (SELECT f.r AS r, min(doc_id) AS class_id FROM f JOIN d ON d.r = f.o GROUP BY 1),
q AS (SELECT key, min(doc_id) AS rep_id FROM n JOIN d ON d.r = n.r GROUP BY 1),
l AS (SELECT x AS r, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, class_id, rep_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links FROM d JOIN c ON c.r = d.r JOIN n ON n.r = d.r JOIN q ON q.key = n.key LEFT JOIN l ON l.r = d.r""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import jaccard

    return jaccard.links(table(spark, sf_dir, "documents"))


@query("op5_ordinal_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import toxicity

    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_cotraining_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import cotraining

    return cotraining.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_suffix_sorting",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, o, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(o) AS least FROM w GROUP BY 1 HAVING min(o) < max(o)),
g AS (SELECT r, i FROM w JOIN f ON w.s = f.s WHERE least < o),
m AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
p AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY 1, 2),
e AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY 1),
x AS (SELECT doc_id, h, n_removed, n_spans, list_concat([0], coalesce(b, [])) AS starts, list_concat(coalesce(a, []), [len(h) // 2]) AS ends FROM d LEFT JOIN e ON d.r = e.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda j: substr(h, 2 * starts[j] + 1, 2 * (ends[j] - starts[j]))), ''))) AS kept_sha256 FROM x""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.llm import suffixes

    return suffixes.digests(table(spark, sf_dir, "documents"))
