"""Registered queries of the training-data operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to the whole of
its table and derives the result columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import decontaminate as de
from lexforge.llm import hardneg, jaccard, langid, licenses, lines, mixing, neighbors, phrases, sharding, substring, toxicity, warc
from lexforge.session import checkpoint_dir
from lexforge.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_ALNUM = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL_SPACE = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        run.__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


@query("op1_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
                  coalesce(len({SQL_SPACE.format('text')}), 0)::BIGINT AS size,
                  ('0x' || substr(md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, '\N'),
                                                coalesce(text, '\N'))), 1, 15))::BIGINT AS ord
           FROM documents),
p AS (SELECT key, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY key),
l AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM p),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, key
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY cap / weight, key
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM l),
t AS (SELECT key, source_size, weight, budget,
             least(cap, coalesce(max(CASE WHEN lev <= cap / weight THEN lev END) OVER (), 'infinity'::DOUBLE) * weight) AS target
      FROM v),
c AS (SELECT d.*, t.source_size, t.weight, t.target, t.budget, k,
             (k * t.source_size + sum(d.size) OVER (PARTITION BY d.key, k ORDER BY ord))::BIGINT / t.weight AS finish
      FROM d JOIN t USING (key), (SELECT unnest([0, 1]) AS k)),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, key, k, ord ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN upto <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM q GROUP BY doc_id, source""")
def op1_mix_sources(spark, sf):
    """Mix all documents to the weights 5, 2, 1 over the sources, 150% of all words."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    mix = mixing.mix(docs, mixing.word_count("text"), identity=("doc_id", "text"))
    return mix.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_decontaminate", f"""
WITH b AS (SELECT item_id, w, CASE WHEN len(w) < 10 THEN [w]
                  ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END AS wins
           FROM (SELECT item_id, {SQL_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, unnest(wins) AS win FROM b),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
d AS (SELECT doc_id, coalesce({SQL_ALNUM}, []) AS w FROM documents),
g AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
h AS (SELECT DISTINCT doc_id, n, i, item_id FROM g JOIN win USING (win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""")
def op2_decontaminate(spark, sf):
    """Benchmark words in all documents, by windows of 10 item words."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = de.find_contamination(docs, read_table(spark, sf, "benchmark"))
    return found.select("doc_id", *de.contamination_digest(found))


@query("op3_license_scan")
def op3_license_scan(spark, sf):
    """Licence phrases and template spans in all documents."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs)
    labels = F.concat("phrase_labels", F.transform("spans", lambda s: s["label"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("phrase_labels", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"), "score")


@query("op4_substring_dedup", rf"""
WITH d AS (SELECT doc_id, coalesce({SQL_SPACE.format('text')}, []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x),
c AS (SELECT DISTINCT doc_id, p FROM (
      SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (x) WHERE least < doc_id)),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
l AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM l ANTI JOIN c ON c.doc_id = l.doc_id AND c.p = l.p
      GROUP BY l.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)""")
def op4_substring_dedup(spark, sf):
    """Words of all documents covered by 13-word windows of documents with smaller ids."""
    kept = substring.remove_duplicates(read_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT h, max(page_id) AS response FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM d LEFT JOIN r ON r.h = d.h AND n >= 1000""")
def op5_warc(spark, sf):
    """All pages written as WARC files and read back."""
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    folder, manifest = warc.write_warc(pages)
    return warc.read_warc(folder, manifest).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query("op6_ngram_jaccard", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce({SQL_SPACE.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w
  FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM g JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = g.doc_id""")
def op6_ngram_jaccard(spark, sf):
    """Classes of all documents linked by 3-word shingle sets of Jaccard 0.9 or more."""
    return jaccard.jaccard_classes(read_table(spark, sf, "documents"), k=3, percent=90)


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, ' ') AS t
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT x.source, t FROM (SELECT source, t, count(DISTINCT doc_id) AS n FROM l WHERE t <> '' GROUP BY source, t) x
        JOIN p ON p.source IS NOT DISTINCT FROM x.source WHERE n >= 5 AND n > pages * 0.02::DOUBLE),
k AS (SELECT l.*, bad.t IS NOT NULL AS drop FROM l LEFT JOIN bad
      ON l.t = bad.t AND l.source IS NOT DISTINCT FROM bad.source)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (drop)::BIGINT AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop) AS kept FROM k GROUP BY doc_id) USING (doc_id)""")
def op7_line_dedup(spark, sf):
    """Boilerplate lines of all documents, the source as the site."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    kept = lines.drop_boilerplate(docs)
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_shard")
def op9_shard(spark, sf):
    """All documents in 40 shards of equal counts that match the mixture of sources."""
    docs = read_table(spark, sf, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.shard(docs, 40, identity=("doc_id", "text_crc32"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op8_language_id")
def op8_language_id(spark, sf):
    """Language of all documents, learned from the two thirds that are not held out."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        "rejected")


@query("op10_nearest_neighbors")
def op10_nearest_neighbors(spark, sf):
    """20 largest inner products of every 20th vector against all others."""
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbors.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op11_toxicity")
def op11_toxicity(spark, sf):
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = toxicity.score_toxicity(docs, read_table(spark, sf, "labels").select("doc_id", "toxic"), ~held_out)
    score = F.col("toxicity")
    return found.select("doc_id", held_out.alias("held_out"), score.alias("score"),
                        (score >= 0.3).cast("int").alias("predicted"))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10""")
def op12_hard_negatives(spark, sf):
    """Hard negatives of every 100th vector for its five best positives."""
    vec = F.col("embedding")
    rows = read_table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
               F.transform(vec, lambda x: F.floor(x.cast("double") * 256))).alias("embedding"))
    found = hardneg.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op13_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, words, count(*) AS f
      FROM (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS words
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY lang, words HAVING count(*) >= 30),
c AS (SELECT lang, words, f, len(words) AS m FROM g WHERE len(words) > 1),
inside AS (SELECT lang, part, max(f) AS longer
           FROM (SELECT lang, words, f, unnest([words[1:2], words[2:3], words[3:4], words[1:3], words[2:4]]) AS part
                 FROM c WHERE m > 2) WHERE len(part) < len(words) AND len(part) > 1 GROUP BY lang, part),
gone AS (SELECT c.lang, c.words FROM c JOIN inside i ON i.lang = c.lang AND i.part = c.words
         WHERE 100 * longer::HUGEINT >= 80 * c.f::HUGEINT),
cut AS (SELECT c.lang, c.words, k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT // (x.f::HUGEINT + y.f))::BIGINT AS score, c.f AS a
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.words = c.words[1:k]
             JOIN g y ON y.lang = c.lang AND y.words = c.words[k + 1:c.m]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
kept AS (SELECT *, array_to_string(words, ' ') AS phrase FROM best ANTI JOIN gone USING (lang, words)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op13_phrase_collocations(spark, sf):
    """The 2000 best phrases of 2 to 4 words of each language in all documents."""
    docs = read_table(spark, sf, "documents").select("text", "lang")
    return phrases.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("pipeline")
def pipeline(spark, sf):
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
