"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_groups
from .html_extract import op6_html
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import op9_pii
from .shared import table
from .substring_dedup import remove_repeats
from .toxicity import op1_toxicity
from .url_templates import op3_urls


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_decontaminate, op3_urls, op4_near, op5_mix, op6_html, op7_lines, op8_exact, op9_pii, op10_substrings)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[p:p + least(len(w), 8) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op5_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, row_number() OVER o AS level, sum(source_size) OVER () AS total,
             coalesce(sum(source_size * 2) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
      FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
f AS (SELECT *, total * 3 - capped * 2 AS free, (total * 3 - capped * 2) * w <= source_size * 4 * w_left AS fits FROM l),
g AS (SELECT *, min(level) FILTER (fits) OVER () AS start FROM f),
t AS (SELECT a.source, a.source_size, CASE WHEN a.start IS NULL OR a.level < a.start THEN (a.source_size * 2)::DOUBLE
             ELSE (b.free * a.w)::DOUBLE / (b.w_left * 2)::DOUBLE END AS target
      FROM g a LEFT JOIN g b ON b.level = a.start),
n AS (SELECT (SELECT greatest(1, ceil(max(c) / 100000))::BIGINT FROM (SELECT count(*) AS c FROM d GROUP BY source)) AS buckets),
o AS (SELECT d.*, t.source_size, t.target,
             least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END, 2.0::DOUBLE) AS rate,
             ('0x' || md5('mix:' || coalesce(d.source, chr(0) || 'null'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)),
                 ('0x' || md5(coalesce(doc_id::VARCHAR, chr(0) || 'null'))[1:8])::BIGINT % n.buckets, d.size, doc_id NULLS FIRST) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, n)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate * i + u) - floor(rate * (i - 1) + u)))::BIGINT AS taken FROM o""",
    "op7_lines": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
x AS (SELECT r, p, line, f.key IS NOT NULL AND f.last IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS kept FROM x GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (r)""",
    "op8_exact": rf"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op10_substrings": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, p, sha256(array_to_string(w[p:p + 12], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least, bool_or(doc_id IS NULL) AS lacking FROM s GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, list(DISTINCT q) AS gone FROM (SELECT r, unnest(range(p, p + 13)) AS q FROM s JOIN m USING (k)
      WHERE m.least < s.doc_id OR s.doc_id IS NULL AND m.least IS NOT NULL) GROUP BY r),
e AS (SELECT d.r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d
      LEFT JOIN c USING (r) WHERE c.gone IS NULL OR NOT list_contains(c.gone, p) GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN e USING (r)""",
}
