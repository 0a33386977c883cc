"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clusters, dialogue, langid, lattice, licenses, minhash, mixing, packing, tokenfile, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicates, by shingles of four words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(words=4)).drop("row_no", "root")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the token files."""
    return tokenfile.token_file(table(spark, sf_dir, "documents"), with_ids=False)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest found of every vector whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    return warc.archive_and_read(table(spark, sf_dir, "pages")).withColumnRenamed("record_id", "page_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest inner products of every vector whose id is divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, learned from those that aren't held out."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, learned from labels that aren't held out."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licenses."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components with its cluster after three rounds."""
    return clusters.with_inertia(clusters.cluster(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of its links at a cosine of 0.95 and what they reach."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings")).drop("row_no").withColumnRenamed("id", "vec_id")


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged in known places, with its faults and its repair."""
    turns = table(spark, sf_dir, "conversations")
    return dialogue.audited(turns, dialogue.repair(dialogue.damaged(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_minhash": op2_minhash,
    "op3_packing": op3_packing,
    "op4_tokenfile": op4_tokenfile,
    "op5_ann": op5_ann,
    "op6_warc": op6_warc,
    "op7_topk": op7_topk,
    "op8_langid": op8_langid,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_clusters": op11_clusters,
    "op12_lattice": op12_lattice,
    "op13_dialogue": op13_dialogue,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "0123456789!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_SHA1 = "sha1(coalesce(html, ''))"

_NEAREST = """a{n} AS MATERIALIZED (SELECT p.vec_id, arg_min(c.cluster, (d.square, c.cluster)) AS cluster, min(d.square) AS distance
  FROM p, c{n} c, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(p.z, c.z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS square) d GROUP BY p.vec_id)"""
_MEANS = """s{n} AS (SELECT a.cluster, i, sum(p.z[i]) AS s, count(*) AS m FROM a{n} a JOIN p ON p.vec_id = a.vec_id, range(1, 65) r(i) GROUP BY a.cluster, i),
m{n} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) / m AS BIGINT) ORDER BY i) AS z FROM (SELECT cluster, i, CAST(s AS HUGEINT) AS s, CAST(m AS HUGEINT) AS m FROM s{n}) GROUP BY cluster),
c{after} AS MATERIALIZED (SELECT c.cluster, coalesce(m.z, c.z) AS z FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster)"""

ORACLE_SQL: dict[str, str] = {
    "op11_clusters": f"""
WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, z FROM p ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(f"{_NEAREST.format(n=n)}, {_MEANS.format(n=n, after=n + 1)}" for n in range(3))}, {_NEAREST.format(n=3)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.z, ',')) AS centroid_sha256 FROM a3 a JOIN c3 c ON c.cluster = a.cluster""",
    "op12_lattice": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.z) = len(b.z) AND list_inner_product(a.z, b.z) / (sqrt(list_inner_product(a.z, a.z)) * sqrt(list_inner_product(b.z, b.z))) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept,
  CASE WHEN v.z IS NULL THEN e.vec_id ELSE min(e.vec_id) OVER (PARTITION BY v.z) END AS class_id
FROM embeddings e LEFT JOIN v ON v.vec_id = e.vec_id JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id""",
    "op1_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  -ln((CAST('0x' || substr(md5('17:' || doc_id), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / coalesce(greatest(CAST(length(translate(text, '{_PLAIN}', '')) AS DOUBLE) / greatest(length(text), 1), 0.05), 0.05) AS key FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, 2.0 * sum(size) AS most, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
s1 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS n FROM s0 WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, (SELECT arg_min(level, n) FROM s1 WHERE most > level * weight) AS open_level FROM s1),
t AS (SELECT source, source_size, CASE WHEN most <= level * weight THEN most ELSE open_level * weight END AS target FROM s2),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, u.source_size, u.target, u.epochs, u.target - u.epochs * u.source_size AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
e AS (SELECT *, upto <= budget AND budget > 0 AS prefix, budget - sum(CASE WHEN upto <= budget AND budget > 0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT source, arg_min(doc_id, (abs(size - gap), key)) AS last_id FROM e WHERE NOT prefix AND abs(size - gap) < gap GROUP BY source)
SELECT e.doc_id, e.size, CAST(e.source_size AS BIGINT) AS source_size, e.target, CAST((e.epochs + CASE WHEN prefix OR e.doc_id = f.last_id THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, e.source FROM e LEFT JOIN f ON e.source IS NOT DISTINCT FROM f.source""",
    "op2_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || '  '] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(sh) > 0 THEN array_to_string(list_sort(sh), chr(10)) ELSE CAST(doc_id AS VARCHAR) END) AS class_id FROM s)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept, class_id FROM s JOIN c ON c.doc_id = s.doc_id JOIN cl ON cl.doc_id = s.doc_id""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, {_SHA1} AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1) FOR j IN range(0, 4)], '') FOR i IN range(0, 8)], '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM b""",
    "op7_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS z FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
