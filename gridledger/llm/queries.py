"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import (
    audit,
    centroids,
    decontam,
    embeddings,
    jaccard,
    language,
    mixing,
    pii,
    secrets,
    suffixes,
    tokens,
    toxicity,
    urls,
)
from gridledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


# Targets of the mixture: sources flattened to the square root of their shares, fixed language shares,
# less of licenses, tables and marked-up text than there is.
MIXTURE = mixing.Settings(
    targets={
        "source": 0.5,
        "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
        "topic": {"prose": 0.86, "license": 0.02, "table": 0.05, "markup": 0.05, "dialogue": 0.02},
    }
)


@query("op1_mixture")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its probability and whether it is drawn."""
    odds = mixing.probabilities(table(spark, sf_dir, "documents"), MIXTURE, carried=["doc_id"])
    return odds.select(
        "doc_id",
        *(F.col(f"_mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens", "probability")),
        (F.col("_mix_draw") < F.col("_mix_probability")).alias("drawn"),
    )


@query("op2_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model)


JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, min(r.y) AS class_id, (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links
FROM documents d JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""


@query("op3_near_duplicates", JACCARD_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

HOST_REPUTATION_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), outcomes AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), hosts0 AS (
  SELECT host, CAST(count(o.bad) AS DOUBLE) AS n, CAST(coalesce(sum(o.bad), 0) AS DOUBLE) AS bad
  FROM parsed p
  LEFT JOIN outcomes o ON o.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '^/[a-z][a-z]/([0-9]+)', 1), '') AS BIGINT)
  GROUP BY host
), named AS (
  SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM hosts0
), hosts AS (
  SELECT host, n, bad, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix FROM named
), total AS (
  SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS mean FROM hosts
), suffixes AS (
  SELECT suffix, (SELECT mean FROM total) AS mean, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix
), suffix_strength AS (
  SELECT 1 / greatest(0.001, least(0.5, coalesce(CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
           THEN sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean)) END, 0.5))) - 1 AS k
  FROM suffixes
), suffix_means AS (
  SELECT suffix, (k * mean + bad) / (k + n) AS mean FROM suffixes, suffix_strength
), domains AS (
  SELECT h.domain, m.mean, sum(n) AS n, sum(bad) AS bad
  FROM hosts h JOIN suffix_means m ON h.suffix = m.suffix GROUP BY h.domain, m.mean
), domain_strength AS (
  SELECT 1 / greatest(0.001, least(0.5, coalesce(CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
           THEN sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean)) END, 0.5))) - 1 AS k
  FROM domains
), domain_means AS (
  SELECT domain, (k * mean + bad) / (k + n) AS mean FROM domains, domain_strength
), placed AS (
  SELECT h.host, h.n, h.bad, m.mean FROM hosts h JOIN domain_means m ON h.domain = m.domain
), host_strength AS (
  SELECT 1 / greatest(0.001, least(0.5, coalesce(CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0
           THEN sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean)) END, 0.5))) - 1 AS k
  FROM placed
), posterior AS (
  SELECT host, k * mean + bad AS a, k * (1 - mean) + n - bad AS b FROM placed, host_strength
), reputation AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS low FROM posterior
), ruled AS (
  SELECT p.page_id, p.host, p.path, r.low,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed p JOIN reputation r USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN low > 0.2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op4_host_reputation", HOST_REPUTATION_SQL)
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url names the document it shows (`/en/123`); that document's labels are the page's
    outcome: bad if toxic or of low quality."""
    parsed = urls.parse_urls(table(spark, sf_dir, "pages"))
    outcomes = (
        table(spark, sf_dir, "labels")
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.expr("toxic = 1 OR quality = 0"), 1).otherwise(0)).alias("bad"))
    )
    shown = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z][a-z]/([0-9]+)', 1), '') AS bigint)")
    labelled = (
        parsed.select("page_id", shown.alias("doc_id"))
        .filter("page_id IS NOT NULL")
        .distinct()
        .join(outcomes, "doc_id")
        .groupBy("page_id")
        .agg(F.max("bad").alias("bad"))
    )
    return urls.judge(parsed, labelled, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op5_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.search(docs, decontam.models(docs, benchmark))


# The key of the registered query; a real run takes its own from a secret store.
DEMONSTRATION_KEY = "gridledger demonstration key"


@query("op6_pseudonyms")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.mask(docs, DEMONSTRATION_KEY, count="n_replaced")


# Whole UTF-8 characters in hexadecimal text, or else one byte that is no part of any.
_NEXT = "[89AB][0-9A-F]"
WHOLE_CHARACTERS = "|".join(
    [
        "[0-7][0-9A-F]",
        f"(?:C[2-9A-F]|D[0-9A-F]){_NEXT}",
        f"E0[AB][0-9A-F]{_NEXT}",
        f"(?:E[1-9A-CEF]{_NEXT}|ED[89][0-9A-F]){_NEXT}",
        f"F0[9AB][0-9A-F]{_NEXT}{_NEXT}",
        f"(?:F[1-3]{_NEXT}|F48[0-9A-F]){_NEXT}{_NEXT}",
        "[89A-F][0-9A-F]",
    ]
)
# Hexadecimal text has two letters per byte, so that places in it are byte places.
REPEATED_BYTES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS starts FROM rep
), grouped AS (
  SELECT r, i, sum(starts) OVER (PARTITION BY r ORDER BY i) AS g FROM marked
), spans AS (
  SELECT r, g, min(i) AS a, max(i) + 400 AS e FROM grouped GROUP BY r, g
), gaps AS (
  SELECT r, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS b FROM spans
), cut AS (
  SELECT d.r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept,
         sum(e - a) AS n_removed, count(*) AS n_spans
  FROM d JOIN gaps ON gaps.r = d.r GROUP BY d.r
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(cut.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(cut.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(cut.kept, d.h))) AS kept_sha256,
       decode(unhex(array_to_string(list_filter(regexp_extract_all(coalesce(cut.kept, d.h), '""" + WHOLE_CHARACTERS + """'),
         lambda x: length(x) > 2 OR x < '8'), ''))) AS text
FROM d LEFT JOIN cut ON cut.r = d.r
"""


@query("op7_repeated_bytes", REPEATED_BYTES_SQL)
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(table(spark, sf_dir, "documents")).drop("kept")


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), component AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.vec_id = e.vec_id
"""


@query("op8_near_vectors", EMBEDDINGS_SQL)
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(path), limit=512)


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op11_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(table(spark, sf_dir, "documents"))


# Failure conditions as worded; an order removes a document at the first of its filters that it fails.
FILTER_AUDIT_SQL = """
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(o) < 5 AND NOT contains(o, f)
), steps AS (
  SELECT o, s, substr(o, s, 1) AS f FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM texts GROUP BY t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), words AS (
  SELECT x.doc_id, part, x.t, first, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         regexp_extract_all(x.t, '[^\\x20\\x09-\\x0D]+') AS w
  FROM texts x JOIN firsts f ON f.t = x.t LEFT JOIN marks m ON m.doc_id = x.doc_id
), failed AS (
  SELECT part, good, toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM words
), kinds AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), judged AS (
  SELECT part, o, s, f, n, good, toxic, fails, contains(fails, f) AS hit,
         len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(substr(o, 1, s - 1), x))) > 0 AS earlier
  FROM kinds, steps
), rows AS (
  SELECT part, o, s, f, sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows
"""


@query("op12_filter_audit", FILTER_AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _clustering_sql(rounds: int = 5, clusters: int = 40) -> str:
    """Lloyd's rounds as one chain of steps: assignment `a<i>`, then centroids `c<i + 1>`."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (
    SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON c.j = v.j GROUP BY v.r, c.k) GROUP BY r
)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT k, j, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT a.k, v.j, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN v ON v.r = a.r GROUP BY a.k, v.j)) m
  ON m.k = c.k AND m.j = c.j
)"""
    steps = []
    for i in range(rounds):
        steps += [nearest.format(i=i), moved.format(i=i, n=i + 1)]
    steps.append(nearest.format(i=rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, unnest(range(1, 65)) AS j, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM kept
), c0 AS MATERIALIZED (
  SELECT k, j, x FROM first JOIN v USING (r) WHERE k < {clusters}
), {', '.join(steps)}, named AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k
)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN named n ON n.k = a.k
"""


@query("op13_centroids", _clustering_sql())
def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
