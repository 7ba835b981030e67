"""The registry of corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import alignment, codes, media, packing, pieces, quality, shards, simhash, templates, tokenfiles, topk, toxicity, urlfilter
from strideline.llm.common import scratch_path, table
from strideline.llm.linear import fold


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


#: op2_topk by brute force.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


#: Bytes of a shard: what a streaming loader fetches at once.
SHARD_BYTES = 1 << 20


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


#: op3_shards: the shortest prefix of the key's hash whose documents fit.
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), up AS (
  SELECT *, hash >> (60 - depth) AS prefix FROM d, range(0, 61) AS r(depth)
), fits AS (
  SELECT depth, prefix FROM up GROUP BY depth, prefix HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1
)
SELECT doc_id, n_bytes, min(CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), CAST(depth AS INTEGER)) END) AS shard
FROM up JOIN fits USING (depth, prefix)
GROUP BY doc_id, n_bytes
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("cause")


#: op5_urls: longest rules, then the components of redirects and canonical links as a recursive closure.
OP5_SQL = r"""
WITH RECURSIVE rules(rhost, rpath, own) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), p AS (
  SELECT page_id, html, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         CASE WHEN contains(url, '://') THEN regexp_replace(url, '(?s)#.*$', '') END AS plain
  FROM pages
), q AS (
  SELECT *, translate(regexp_extract(plain, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_replace(plain, '(?s)^.*?://[^/?]*', '') AS address
  FROM p
), fits AS (
  SELECT host, path, min((-length(rhost || rpath), own, rhost || rpath)) AS best
  FROM (SELECT DISTINCT host, path FROM q), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
), j AS (
  SELECT q.*, fits.best[3] AS rule, fits.best[2] AS own FROM q LEFT JOIN fits USING (host, path)
), tags AS (
  SELECT address AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM q WHERE address IS NOT NULL
), found AS (
  SELECT a, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)
                 WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END AS b
  FROM tags
), pairs AS (
  SELECT a, b FROM found WHERE contains(b, '://') UNION SELECT b, a FROM found WHERE contains(b, '://')
), reach(a, b) AS (
  SELECT a, a FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), votes AS (
  SELECT reach.a AS address, min(j.own) AS alias FROM reach JOIN j ON j.address = reach.b WHERE j.own IS NOT NULL GROUP BY reach.a
)
SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict FROM j LEFT JOIN votes USING (address)
"""


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_model(spark: SparkSession, sf_dir: str) -> quality.RuleEnsemble:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.write_archives(media.images(table(spark, sf_dir, "documents")), path)
    back = media.decoded(media.read_archives(spark, path))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.WordModel:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.line_dedup(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "dropped_lines", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: op9_lines with its default parameters.
OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS spot
  FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT *, len(string_split(line, ' ')) AS size,
         CAST(len(string_split(line, ' ')) AS VARCHAR) || ' ' || regexp_replace(array_to_string(string_split(line, ' ')[1:3], ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS leaf
  FROM l WHERE len(string_split(line, ' ')) >= 5
), d AS (
  SELECT leaf, line, size, count(DISTINCT text) AS texts FROM c GROUP BY leaf, line, size
), t AS (
  SELECT leaf, line, size, texts, unnest(string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ')) AS token,
         unnest(range(size)) AS place
  FROM d
), s AS (
  SELECT leaf, place, token FROM t WHERE token <> '<*>' GROUP BY leaf, size, place, token HAVING sum(texts) >= CASE WHEN size >= 50 THEN 2 ELSE 3 END
), k AS (
  SELECT leaf, line, size, leaf || list(place || ':' || token ORDER BY place)::VARCHAR AS template
  FROM t JOIN s USING (leaf, place, token)
  GROUP BY leaf, line, size
  HAVING count(*) >= 5 AND count(*) >= ceil(size * 0.8)
), f AS (
  SELECT c.doc_id, c.text, c.spot, size, template FROM c JOIN k USING (leaf, line, size)
), r AS (
  SELECT template FROM f GROUP BY template, size HAVING count(DISTINCT text) >= CASE WHEN size >= 50 THEN 2 ELSE 3 END
), o AS (
  SELECT doc_id, spot, row_number() OVER (PARTITION BY template ORDER BY doc_id, spot) AS turn FROM f JOIN r USING (template)
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE turn > 1) AS dropped_lines,
       md5(coalesce(string_agg(line, chr(10) ORDER BY l.spot) FILTER (WHERE turn IS NULL OR turn = 1), '')) AS kept_md5
FROM l LEFT JOIN o ON l.doc_id = o.doc_id AND l.spot = o.spot
GROUP BY l.doc_id
"""


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.summary(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """op11_codes by Lloyd's rounds over every part of every row."""
    steps = [
        f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS cells
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT vec_id, label, place, cells[place * len(cells) // {parts} + 1 : (place + 1) * len(cells) // {parts}] AS part FROM v, range({parts}) AS r(place)
), c0 AS (
  SELECT place, entry, part FROM (SELECT place, part, row_number() OVER (PARTITION BY place ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS (
  SELECT p.place, p.vec_id, p.label, p.part,
         min((list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - c.part[i]) * (p.part[i] - c.part[i]))), c.entry)) AS near
  FROM p JOIN c{k} c USING (place) GROUP BY p.place, p.vec_id, p.label, p.part
)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (
  SELECT place, near[2] AS entry, i, CAST(sum(part[i]) AS BIGINT) AS total, count(*) AS n
  FROM a{k}, LATERAL (SELECT unnest(range(1, len(part) + 1)) AS i) GROUP BY place, near[2], i
), n{k} AS (
  SELECT place, entry, list((total - ((total % n) + n) % n) // n ORDER BY i) AS part FROM m{k} GROUP BY place, entry
), c{k + 1} AS (
  SELECT place, entry, coalesce(n{k}.part, c{k}.part) AS part FROM c{k} LEFT JOIN n{k} USING (place, entry)
)"""
            )
    steps.append(
        f"""e AS (
  SELECT vec_id, label, string_agg(right('0' || lower(to_hex(near[2])), 2), '' ORDER BY place) AS code, CAST(sum(near[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
), s AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY place, entry)) AS codebooks_sha256 FROM c{rounds}
)"""
    )
    return "WITH " + ", ".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, s"


OP11_SQL = _codes_sql()


def op12_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokenfiles")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read(spark, path, digest=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b)[0]


def queries() -> dict:
    return {"op1_simhash": op1_simhash, "op2_topk": op2_topk, "op3_shards": op3_shards, "op4_packing": op4_packing, "op5_urls": op5_urls, "op6_pieces": op6_pieces, "op7_quality": op7_quality, "op8_media": op8_media, "op9_lines": op9_lines, "op10_toxicity": op10_toxicity, "op11_codes": op11_codes, "op12_tokenfiles": op12_tokenfiles, "op13_alignment": op13_alignment}


def oracle_sql() -> dict:
    return {"op2_topk": OP2_SQL, "op3_shards": OP3_SQL, "op5_urls": OP5_SQL, "op9_lines": OP9_SQL, "op11_codes": OP11_SQL}
