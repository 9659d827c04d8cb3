"""Query keys of this package: thin digests over its operators, one per
operator, with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out

QUERIES: dict = {}
ORACLES: dict = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rank_file() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    from . import bpe
    path, pattern = rank_file()
    return bpe.digests(table(spark, sf_dir, "documents"), path, pattern)


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    from . import simhash
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op7_language_mixture")
def op7_language_mixture(spark, sf_dir):
    from . import langmix
    docs = table(spark, sf_dir, "documents")
    model = langmix.fit(docs.where(~held_out(F.col("doc_id"))))
    return langmix.identify(docs, model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


@query("op6_quality_lines")
def op6_quality_lines(spark, sf_dir):
    from . import crf
    docs = table(spark, sf_dir, "documents")
    return crf.judge(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_quality_nbsvm")
def op4_quality_nbsvm(spark, sf_dir):
    from . import nbsvm
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "margin")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
         md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS g
  FROM documents),
s AS (
  SELECT source, sum(n)::BIGINT AS size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2 * size AS cap,
         (CAST(1.5 AS DOUBLE) * (sum(size) OVER ())::DOUBLE
          - COALESCE(sum(2 * size) OVER (ORDER BY 2.0 * size / w, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY 2.0 * size / w, source NULLS LAST
                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM s),
t AS (
  SELECT source, size, CASE WHEN l.lvl IS NULL OR l.lvl * w >= cap THEN cap::DOUBLE ELSE l.lvl * w END AS target
  FROM c, (SELECT (SELECT lvl FROM c WHERE lvl * w < cap ORDER BY 2.0 * size / w, source NULLS LAST LIMIT 1) AS lvl) l),
p AS (
  SELECT *, CASE WHEN whole < 2 THEN target - whole * size ELSE 0.0 END AS extra
  FROM (SELECT *, CASE WHEN size > 0 THEN least(floor(target / size), 2)::BIGINT ELSE 0 END AS whole FROM t) x),
k AS (
  SELECT d.source, d.g, d.n, count(*) AS times, sum(d.n)::BIGINT AS words FROM d GROUP BY ALL),
o AS (
  SELECT k.*, p.extra, row_number() OVER (PARTITION BY k.source ORDER BY g, k.n) AS i
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
z AS (
  SELECT source, list_reduce(
    list_prepend({'rest': extra::DOUBLE, 'w': 0::BIGINT, 'ids': []::BIGINT[]}, list({'rest': 0::DOUBLE, 'w': words, 'ids': [i]} ORDER BY i)),
    lambda a, x: {'rest': CASE WHEN x.w <= a.rest THEN a.rest - x.w ELSE a.rest END, 'w': 0::BIGINT,
                  'ids': CASE WHEN x.w <= a.rest THEN a.ids || x.ids ELSE a.ids END}) AS z
  FROM o GROUP BY source, extra),
r AS (
  SELECT o.*, z.z.rest AS rest, extra > 0 AND list_contains(z.z.ids, i) AS fits FROM o JOIN z ON o.source IS NOT DISTINCT FROM z.source),
b AS (
  SELECT *, extra > 0 AND NOT fits AND n > 0 AND times = 1 AND abs(n - rest) < rest AS able FROM r),
f AS (
  SELECT source, g, n, fits OR (able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(n - rest), g, n) = 1) AS more
  FROM b)
SELECT d.doc_id, d.n AS size, p.size AS source_size, p.target,
       (d.n * (p.whole + CASE WHEN f.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.g = f.g AND d.n = f.n
"""


@query("op3_source_mix", OP3_SQL)
def op3_source_mix(spark, sf_dir):
    from . import mixing
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), prefix="m_")
    return mixed.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
                        F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"))


@query("op10_minimax_shards")
def op10_minimax_shards(spark, sf_dir):
    from . import sharding
    rows = sharding.assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op8_html_density")
def op8_html_density(spark, sf_dir):
    from . import htmltext
    return htmltext.extract(table(spark, sf_dir, "pages"))


def _op1_sql() -> str:
    from . import licenses
    rows = ", ".join(f"({k}, '{name}', '{b}')" for k, (name, text) in enumerate(licenses.TEMPLATES)
                     for b in licenses.template_bigrams(text))
    return rf"""
WITH tpl(template, license, bigram) AS (VALUES {rows}),
size_of AS (SELECT template, license, count(*) AS nt FROM tpl GROUP BY ALL),
norm AS (SELECT row_number() OVER () AS row, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
         FROM documents WHERE text IS NOT NULL),
grams AS MATERIALIZED (
  SELECT row, i - 1 AS i, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM norm) x),
hits AS MATERIALIZED (SELECT row, template, license, i, bigram FROM grams JOIN tpl USING (bigram)),
enough AS (
  SELECT row, template, nt FROM hits JOIN size_of USING (template) GROUP BY ALL HAVING count(DISTINCT bigram) >= 0.8 * nt / 1.2 - 1e-9),
heads AS (
  SELECT row, template, i AS start, nt FROM (
    SELECT h.*, nt, lag(i) OVER (PARTITION BY row, template ORDER BY i) AS before FROM hits h JOIN enough USING (row, template)) x
  WHERE before IS NULL OR before < i - 1),
seen AS (
  SELECT row, template, start, nt, bigram, min(i) AS i FROM heads JOIN grams USING (row) WHERE i >= start GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row, template, start ORDER BY i) AS n FROM seen),
scored AS (
  SELECT r.*, license, 2 * row_number() OVER (PARTITION BY row, template, start ORDER BY n) / (n + nt)::DOUBLE AS score
  FROM ranked r JOIN tpl USING (template, bigram)),
best AS (
  SELECT row, license, template, start, score, n, i + 1 AS stop FROM scored WHERE score >= 0.8
  QUALIFY row_number() OVER (PARTITION BY row, template, start ORDER BY score DESC, n) = 1),
kept AS (
  SELECT row, list_reduce(list([{{'license': license, 'start': start, 'stop': stop, 'score': score}}] ORDER BY score DESC, n DESC, start, template),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda a: a.start <= x[1].stop AND x[1].start <= a.stop)) > 0 THEN kept ELSE kept || x END) AS k
  FROM best GROUP BY row)
SELECT doc_id, u.license AS license, u.start AS place, u.stop - u.start + 1 AS n_words, u.score AS score
FROM (SELECT row, unnest(k) AS u FROM kept) x JOIN norm USING (row)
"""


@query("op1_license_dice", _op1_sql())
def op1_license_dice(spark, sf_dir):
    from . import licenses
    return licenses.scan(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT e.vec_id, COALESCE(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, COALESCE(c.low, e.vec_id)) AS component_id,
       least(e.vec_id, COALESCE(c.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""


@query("op2_itq_near_dup", OP2_SQL)
def op2_itq_near_dup(spark, sf_dir):
    from . import itq
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH tbl AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v::BIGINT)
              ORDER BY v) AS t FROM range(256) r(v)),
f AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), NULL,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
x AS MATERIALIZED (SELECT side, row, unnest(w) AS word FROM f),
crc AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))),
                                              lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM x) u, tbl),
n AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM x JOIN crc USING (word) GROUP BY bucket),
z AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM x),
g AS (
  SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM n, z),
w AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM x JOIN crc USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row),
r AS (
  SELECT f.row, doc_id, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
         COALESCE(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                               / 4294967296::DOUBLE)))::BIGINT AS score
  FROM f LEFT JOIN w ON f.row = w.row WHERE side = 'd'),
o AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM r LEFT JOIN o ON r.row = o.row
"""


@query("op11_importance_ahocorasick", OP11_SQL)
def op11_importance_ahocorasick(spark, sf_dir):
    from . import importance
    found = importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT COALESCE(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0) x) y),
dw AS (
  SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) s) x),
m AS MATERIALIZED (SELECT row, i, size, item FROM dw JOIN bw USING (size, gram)),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM m) x GROUP BY row),
n AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM m) x GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.row = h.row LEFT JOIN n ON d.row = n.row
"""


@query("op12_decontam_automaton", OP12_SQL)
def op12_decontam_automaton(spark, sf_dir):
    from . import decontam
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def _op13_sql(rounds: int = 10) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT x.row, m.c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS d FROM x JOIN c{r} m USING (i) GROUP BY ALL) q GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, COALESCE(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT a.c, x.i, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM x JOIN a{r} a USING (row) GROUP BY ALL) n ON o.c = n.c AND o.i = n.i)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 131072)) = 0),
x AS MATERIALIZED (SELECT row, unnest(range(64)) AS i, unnest(v) AS x FROM v),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || COALESCE(vec_id::VARCHAR, '')), v) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT s.c, x.i, x.x FROM s JOIN x USING (row) WHERE s.c < 8),{",".join(steps)},
h AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM v JOIN a{rounds} a USING (row) JOIN h ON h.c = a.c
"""


@query("op13_laesa_centroids", _op13_sql())
def op13_laesa_centroids(spark, sf_dir):
    from . import laesa
    return laesa.cluster(table(spark, sf_dir, "embeddings"))
