"""Registered queries over whole tables, and the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .fingerprint import op9_fingerprint
from .media import op6_media
from .minhash import op2_minhash
from .mixing import op7_mixing
from .packing import exact_cluster, op1_best_fit_packing
from .quality import op3_quality
from .sharding import op10_jump_sharding
from .suffix import op5_suffix
from .superkmer import op4_superkmer
from .toxicity import op8_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_superkmer": op4_superkmer,
    "op5_suffix": op5_suffix,
    "op6_media": op6_media,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprint": op9_fingerprint,
    "op10_jump_sharding": op10_jump_sharding,
}

ORACLE_SQL: dict[str, str] = {}

# --------------------------------------------------------------------------- what SQL can say of the others


def packing_invariants(spark, sf_dir: str) -> DataFrame:
    """One row over all of op1's result: documents, words placed, and the bins that are too full or hold two pieces of a source or of a cluster of copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", exact_cluster(F.col("text")).alias("cluster"))
    packed = Scratch(spark, "invariants").keep(op1_best_fit_packing(spark, sf_dir))
    bins = packed.filter("bin is not null").join(docs, "doc_id").groupBy("bin").agg(
        F.sum("size").alias("size"),
        (F.count("source") - F.countDistinct("source")).alias("sources"),
        (F.count("cluster") - F.countDistinct("cluster")).alias("copies"),
    )
    bad = bins.agg(F.count(F.when(F.col("size") > 1024, 1)).alias("too_full"), F.count(F.when(F.col("sources") > 0, 1)).alias("shared_sources"), F.count(F.when(F.col("copies") > 0, 1)).alias("shared_copies"))
    return packed.agg(F.countDistinct("doc_id").alias("documents"), F.sum("size").alias("words")).join(bad)


QUERIES |= {
    "packing_invariants": packing_invariants,
    "quality_folds": lambda spark, sf_dir: op3_quality(spark, sf_dir).select("doc_id", "held_out", (F.col("score").between(0, 1) & ((F.col("score") >= 0.5) == (F.col("predicted") == 1))).alias("consistent")),
    "media_payloads": lambda spark, sf_dir: op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"),
    "toxicity_folds": lambda spark, sf_dir: op8_toxicity(spark, sf_dir).select("doc_id", "held_out", (F.col("score").between(0, 1) & ((F.col("score") >= 0.3) == (F.col("predicted") == 1))).alias("consistent")),
    "edited_texts": lambda spark, sf_dir: op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256"),
}

#: t: the table of CRC-32, by its rule.
_CRC = """t AS MATERIALIZED (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i) AS r FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(b: str) -> str:
    return f"""xor(list_reduce(list_transform(range(1, octet_length({b}) + 1), lambda i: ('0x' || hex({b}[i : i]))::BIGINT),
                              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT"""


ORACLE_SQL["packing_invariants"] = """
SELECT count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS words,
       0::BIGINT AS too_full, 0::BIGINT AS shared_sources, 0::BIGINT AS shared_copies FROM documents
"""
for _name, _parts, _part in (("quality_folds", 3, 1), ("toxicity_folds", 4, 2)):
    ORACLE_SQL[_name] = f"WITH {_CRC}, d AS (SELECT doc_id, encode(doc_id::VARCHAR) AS b FROM documents) SELECT doc_id, {_crc('b')} % {_parts} = {_part} AS held_out, true AS consistent FROM d, t"
ORACLE_SQL["media_payloads"] = f"""
WITH {_CRC}, d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b || encode(repeat(' ', (greatest(192, (octet_length(b) + 191) // 192 * 192) - octet_length(b))::INT)) AS p FROM d),
q AS (SELECT *, p[octet_length(p) - 15 : octet_length(p)] AS tail FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, octet_length(p)::BIGINT AS payload_bytes, sha256(p) AS payload_sha256, {_crc('tail')} AS tail_crc32 FROM q, t
"""
ORACLE_SQL["edited_texts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 4 AS q, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substring(t, 1, length(t) - q) || substring(next, 1, q)) AS edited_sha256 FROM n
"""

ORACLE_SQL["op7_mixing"] = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '7', doc_id::VARCHAR)) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight, 2.0 * source_size AS cap FROM s),
c AS (
  SELECT *, least(sum(source_size) OVER () * 1.5, sum(cap) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT *, (total - capped) / open AS level, (total - capped) / open * weight < cap AS free FROM c),
t AS (
  SELECT source, source_size, least(cap, CASE WHEN free THEN (arg_min(level, cap / weight) FILTER (free) OVER ()) * weight ELSE cap END) AS target FROM l),
r AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - ahead)))::BIGINT AS taken, source
FROM r
"""

ORACLE_SQL["op2_minhash"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

ORACLE_SQL["op4_superkmer"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM s JOIN again USING (g)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (
  SELECT doc_id, count(*) AS n_removed_not, string_agg(word, ' ' ORDER BY i) AS kept
  FROM words LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_removed_not, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL["op5_suffix"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, b[i : i + 199] AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM s JOIN again USING (g)),
island AS (SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS z FROM island GROUP BY doc_id, k),
piece AS (SELECT span.doc_id, a, z, hex(b[coalesce(lag(z) OVER w, 1) : a - 1]) AS before, lead(z) OVER w IS NULL AS last, hex(b[z : octet_length(b)]) AS after
          FROM span JOIN d USING (doc_id) WINDOW w AS (PARTITION BY span.doc_id ORDER BY a)),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) || coalesce(max(after) FILTER (last), '') AS kept FROM piece GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN k.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

# The CRC goes byte by byte through its table; a key's jumps are replayed with whole numbers modulo 2**64.
ORACLE_SQL["op10_jump_sharding"] = f"""
WITH RECURSIVE {_CRC},
d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
c AS (SELECT row, {_crc('b')} AS text_crc32 FROM d, t),
jump AS (
  SELECT row, n, ('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM d, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT row, n, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1.0)))::BIGINT
  FROM (SELECT row, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jump WHERE j < n)),
s AS (SELECT row, max(b) FILTER (n = 16)::INT AS shard, max(b) FILTER (n = 17)::INT AS grown_shard FROM jump GROUP BY row)
SELECT doc_id, octet_length(b)::BIGINT + 1 AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(m, 17), doc_id, text_crc32, octet_length(b)) - 1 AS slot, grown_shard
FROM d JOIN c USING (row) JOIN s USING (row)
"""
