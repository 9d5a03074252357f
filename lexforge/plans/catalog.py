"""Registered queries (one per survey operator) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, reads the driver tables and returns a
DataFrame; every computed column is aliased to the same name in the SQL.
Floats are rounded to 6 digits and arrays rendered with ``array_join`` on
both sides so the order-insensitive value hash is engine-independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions.hashing import hash_key, hex_uniform
from lexforge.operators import vocab
from lexforge.session import drop_written, written
from lexforge.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def docs(spark, sf):
    """A1: corpus scan, pruned to (doc_id, text), spread over the cluster."""
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# --- SQL building blocks (same rules as lexforge.functions.text) -----------
SQL_CLEAN_WORDS = (r"regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), "
                   r"'[^!-/:-@\[-`{-~\t\n\x0B\f\r\x1C-\x1F ]+')")
SQL_WC = f"SELECT word, count(*) AS n FROM (SELECT unnest({SQL_CLEAN_WORDS}) AS word FROM documents) GROUP BY word"
SQL_RANKED = f"""
  SELECT word, n,
         CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS BIGINT) AS rank,
         CAST(coalesce(sum(n) OVER (ORDER BY n DESC, word
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
         sum(n) OVER () AS total
  FROM ({SQL_WC})"""


# =========================== F / D8 / G1: word statistics ==================

@query("f1_word_count", f"SELECT word, CAST(n AS BIGINT) AS n FROM ({SQL_WC})")
def f1_word_count(spark, sf):
    """word counts over all documents (ASCII fold, punctuation/whitespace split)."""
    return vocab.word_counts(docs(spark, sf))


@query("f2_corpus_totals", f"""
SELECT CAST(sum(n) AS BIGINT) AS total_words, CAST(count(*) AS BIGINT) AS distinct_words
FROM ({SQL_WC})""")
def f2_corpus_totals(spark, sf):
    """total word occurrences and number of distinct words."""
    return vocab.corpus_totals(vocab.word_counts(docs(spark, sf)))


@query("d8_most_common", f"SELECT word, n, rank FROM ({SQL_RANKED})")
def d8_most_common(spark, sf):
    """Dense rank by count desc, word asc (distributed prefix, no global window)."""
    return vocab.most_common(vocab.word_counts(docs(spark, sf))).select("word", "n", "rank")


@query("g1_coverage_cut", f"""
SELECT word, n, rank, n_before FROM ({SQL_RANKED})
WHERE n_before * 10 < 9 * total""")
def g1_coverage_cut(spark, sf):
    """G1: smallest most-common-first word list covering 90% of occurrences."""
    return vocab.coverage_cut(vocab.word_counts(docs(spark, sf)))


# =========================== E: text functions ============================
from lexforge.operators import sampling, sentences  # noqa: E402

SQL_SENT_PARTS = r"""list_transform(regexp_extract_all(text, '(?s).*?[.!?]["'')\]]*[\t\n\x0B\f\r ]+|.+'),
    lambda x: regexp_replace(x, '([.!?]["'')\]]*)[\t\n\x0B\f\r ]+$', '\1'))"""
SQL_NOT_BLANK = r"NOT regexp_full_match(parts[i], '[\t\n\x0B\f\r ]*')"
SQL_PRETOKEN = (r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[!-/:-@\[-`{-~\p{P}]"
                r"|[^\p{L}\p{N}\p{M}\p{P}\s!-/:-@\[-`{-~]+')")


@query("e1_newline_fold", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def e1_newline_fold(spark, sf):
    """Newlines folded to spaces (one document per line)."""
    return docs(spark, sf).select("doc_id", tx.fold_newlines("text").alias("text"))


@query("e2_sentence_split", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, parts[i] AS sentence
FROM (SELECT doc_id, {SQL_SENT_PARTS} AS parts FROM documents) s,
     unnest(generate_series(1, len(s.parts))) AS t(i)
WHERE {SQL_NOT_BLANK}""")
def e2_sentence_split(spark, sf):
    """Rule-based sentence split of every document, order kept."""
    return sentences.split_sentences(docs(spark, sf))


# NFKD, lower case and without marks, for the letters of these tables
SQL_NORM = ("trim(strip_accents(lower(replace(text, chr(10), ' '))), "
            "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@query("e3_normalize", "SELECT doc_id, " + SQL_NORM + " AS text FROM documents")
def e3_normalize(spark, sf):
    """NFKD, newline->space, lowercase, strip accents, strip (one Arrow pass)."""
    return tx.normalize_rows(docs(spark, sf), "text", "norm").select("doc_id", F.col("norm").alias("text"))


@query("e4_pretokenize", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, toks[i] AS token
FROM (SELECT doc_id, {SQL_PRETOKEN} AS toks FROM documents) s,
     unnest(generate_series(1, len(s.toks))) AS t(i)""")
def e4_pretokenize(spark, sf):
    """whitespace/punctuation pre-tokens of every document."""
    return sentences.pretokens(docs(spark, sf))


@query("e5_ascii_fold", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents")
def e5_ascii_fold(spark, sf):
    """E5: non-ASCII characters dropped."""
    return docs(spark, sf).select("doc_id", tx.ascii_fold("text").alias("text"))


@query("e6_punct_to_space", r"SELECT doc_id, regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g') AS text FROM documents")
def e6_punct_to_space(spark, sf):
    """ASCII punctuation replaced by spaces."""
    return docs(spark, sf).select("doc_id", tx.punct_to_space("text").alias("text"))


@query("e7_whitespace_fold", r"SELECT doc_id, regexp_replace(text, '[ \t\n\r\x0B\f]+', ' ', 'g') AS text FROM documents")
def e7_whitespace_fold(spark, sf):
    """Whitespace runs folded to one space."""
    return docs(spark, sf).select("doc_id", tx.whitespace_fold("text").alias("text"))


@query("e8_word_split", r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS word_idx, ws[i] AS word
FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(
        regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'),
        '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r\x0B\f]+', ' ', 'g')),
        '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda w: w <> '') AS ws FROM documents) s,
     unnest(generate_series(1, len(s.ws))) AS t(i)""")
def e8_word_split(spark, sf):
    """Cleaned text (E5-E7) split into words, case kept."""
    words = tx.split_words(tx.clean_ascii("text"))
    return (docs(spark, sf).select("doc_id", F.posexplode(words).alias("word_idx", "word"))
            .withColumn("word_idx", F.col("word_idx").cast("int")))


@query("e9_end_of_word", f"""
SELECT word,
       array_to_string(list_transform(regexp_extract_all(word, '(?s).'),
           lambda c, i: CASE WHEN i = length(word) THEN c || '</w>' ELSE c END), '|') AS lib_symbols,
       array_to_string(list_concat(regexp_extract_all(word, '(?s).'), [' ']), '|') AS space_symbols
FROM ({SQL_WC})""")
def e9_end_of_word(spark, sf):
    """Initial BPE symbols of every distinct word, both end-of-word modes."""
    wc = vocab.word_counts(docs(spark, sf))
    return wc.select("word",
                     F.array_join(tx.end_of_word_symbols("word", "</w>"), "|").alias("lib_symbols"),
                     F.array_join(tx.end_of_word_symbols("word", " "), "|").alias("space_symbols"))


SQL_RUNLOG_ELAPSED = """
SELECT event_id, user_id,
       epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS secs
FROM events"""


@query("e10_mm_ss", f"""
SELECT event_id, printf('%02d:%02d', CAST(floor(secs / 60) AS BIGINT),
                        CAST(floor(secs - 60 * floor(secs / 60)) AS BIGINT)) AS elapsed
FROM ({SQL_RUNLOG_ELAPSED})""")
def e10_mm_ss(spark, sf):
    """Elapsed time since the run's first record, as mm:ss."""
    ev = read_table(spark, sf, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # per-run minimum via aggregate + join (partial aggregation, skew-safe)
    start = ev.groupBy("user_id").agg(F.min("us").alias("us0"))
    secs = (F.col("us") / 1e6) - (F.col("us0") / 1e6)
    return ev.join(start, "user_id").select("event_id", tx.seconds_to_mmss(secs).alias("elapsed"))


# =========================== C / D: sampling, shards, chunks ===============
SEED = 0


def sql_md5(seed, *cols):
    inner = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5('{seed}:' || {inner})"


SQL_DOC_SHUFFLE = f"""
SELECT doc_id, text,
       CAST(row_number() OVER (ORDER BY {sql_md5(SEED, 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos,
       count(*) OVER () AS total
FROM documents"""


def sql_contiguous_shard(pos, total, n):
    div, mod = f"({total} // {n})", f"({total} % {n})"
    big = f"(({div} + 1) * {mod})"
    return (f"CAST(CASE WHEN {pos} < {big} THEN {pos} // ({div} + 1) "
            f"ELSE {mod} + ({pos} - {big}) // greatest({div}, 1) END AS INTEGER)")


N_SHARDS = 8
FILE_SIZE = 1000


def doc_total(spark, sf):
    """Document count as a scalar subquery over the source scan."""
    return read_table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()


def shuffled_docs(spark, sf, seed=SEED):
    return sampling.shuffle_positions(docs(spark, sf), "doc_id", seed)


@query("a1_corpus_scan", "SELECT doc_id, text FROM documents")
def a1_corpus_scan(spark, sf):
    """A1: corpus scan projected to (doc_id, text) - pruned at the parquet reader."""
    return docs(spark, sf)


@query("d1_seeded_shuffle", f"SELECT doc_id, pos FROM ({SQL_DOC_SHUFFLE})")
def d1_seeded_shuffle(spark, sf):
    """Seeded, reproducible document order (md5 of seed:doc_id)."""
    return shuffled_docs(spark, sf).select("doc_id", "pos")


@query("c1_prefix_select", """
SELECT doc_id, pos FROM (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents)
WHERE pos < 500""")
def c1_prefix_select(spark, sf):
    """The first 500 documents in dataset (doc_id) order."""
    d = sampling.first_rows(read_table(spark, sf, "documents").select("doc_id"), "doc_id", 500)
    return sampling.prefix_select(sampling.stable_positions(d, ["doc_id"]), "pos", 500)


@query("d2_exact_sample", f"""
SELECT doc_id, sample_pos FROM (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY {sql_md5(1, 'doc_id')}, doc_id) - 1 AS BIGINT)
         AS sample_pos FROM documents)
WHERE sample_pos < 300""")
def d2_exact_sample(spark, sf):
    """Exact sample of 300 documents without replacement (seed 1)."""
    return sampling.exact_sample(read_table(spark, sf, "documents").select("doc_id"), "doc_id", 300, 1)


@query("d3_shard_contiguous", f"""
SELECT doc_id, pos, {sql_contiguous_shard('pos', 'total', N_SHARDS)} AS shard
FROM ({SQL_DOC_SHUFFLE})""")
def d3_shard_contiguous(spark, sf):
    """D3: contiguous shards over the shuffled order (first N % n shards +1 row)."""
    d = shuffled_docs(spark, sf).select("doc_id", "pos")
    return sampling.assign_shards(d, "pos", N_SHARDS, "contiguous", total=doc_total(spark, sf))


@query("d3_shard_strided", f"""
SELECT doc_id, pos, CAST(pos % {N_SHARDS} AS INTEGER) AS shard FROM ({SQL_DOC_SHUFFLE})""")
def d3_shard_strided(spark, sf):
    """D3: strided shards (pos mod n) over the shuffled order."""
    d = shuffled_docs(spark, sf).select("doc_id", "pos")
    return sampling.assign_shards(d, "pos", N_SHARDS, "strided")


@query("c3_shard_prefix", f"""
SELECT doc_id, shard FROM (
  SELECT doc_id, {sql_contiguous_shard('pos', 'total', N_SHARDS)} AS shard FROM ({SQL_DOC_SHUFFLE}))
WHERE shard <= 2""")
def c3_shard_prefix(spark, sf):
    """Keep shards 0..2 only."""
    d = sampling.assign_shards(shuffled_docs(spark, sf).select("doc_id", "pos"), "pos", N_SHARDS,
                               total=doc_total(spark, sf))
    return sampling.shard_prefix(d, 2).select("doc_id", "shard")


SQL_SHARD_SENTENCES = f"""
SELECT doc_id, shard, CAST(i - 1 AS INTEGER) AS sent_idx, parts[i] AS sentence
FROM (SELECT doc_id, {sql_contiguous_shard('pos', 'total', N_SHARDS)} AS shard,
             {SQL_SENT_PARTS} AS parts FROM ({SQL_DOC_SHUFFLE})) s,
     unnest(generate_series(1, len(s.parts))) AS t(i)
WHERE {SQL_NOT_BLANK}"""
SQL_SHARD_SHUFFLED = f"""
SELECT doc_id, shard, sent_idx, sentence,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY {sql_md5(SEED, 'doc_id', 'sent_idx')},
            doc_id, sent_idx) - 1 AS BIGINT) AS pos
FROM ({SQL_SHARD_SENTENCES})"""


def shard_sentences(spark, sf):
    """Shuffled documents -> contiguous shards -> sentences (P1 steps 3-7)."""
    d = sampling.assign_shards(shuffled_docs(spark, sf), "pos", N_SHARDS,
                               total=doc_total(spark, sf)).drop("pos")
    return sentences.split_sentences(d)


def shuffled_shard_sentences(spark, sf):
    """... -> in-shard seeded sentence shuffle (P1 step 8)."""
    return sampling.shuffle_positions(shard_sentences(spark, sf), ["doc_id", "sent_idx"], SEED,
                                      partition=["shard"])


@query("d4_in_shard_shuffle", f"SELECT doc_id, shard, sent_idx, pos FROM ({SQL_SHARD_SHUFFLED})")
def d4_in_shard_shuffle(spark, sf):
    """Seeded sentence order within each shard."""
    return shuffled_shard_sentences(spark, sf).select("doc_id", "shard", "sent_idx", "pos")


@query("d7_chunk_files", f"""
SELECT shard, CAST(pos // {FILE_SIZE} AS INTEGER) AS file_idx, CAST(count(*) AS BIGINT) AS n_rows
FROM ({SQL_SHARD_SHUFFLED}) GROUP BY 1, 2""")
def d7_chunk_files(spark, sf):
    """Sentences per (shard, file) when files hold 1000 rows (last short)."""
    s = sampling.chunk(shuffled_shard_sentences(spark, sf), "pos", FILE_SIZE)
    return s.groupBy("shard", "file_idx").agg(F.count(F.lit(1)).alias("n_rows"))


# =========================== H6-H9, K, C2, M: encode, batch, mask ==========
from lexforge.operators import batching, encode, masking  # noqa: E402
from lexforge.plans import corpus_shards as P1  # noqa: E402

VOCAB = 2000
SEQ_LEN = 64
BATCH = 512
SQL_LOWER_PRETOKEN = SQL_PRETOKEN.replace("regexp_extract_all(text,", "regexp_extract_all(lower({x}),")


def sql_pretok_lower(x):
    return SQL_LOWER_PRETOKEN.replace("{x}", x)


def with_ctes(ctes, final):
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + final


CTE_TOKENS = [
    ("s", SQL_SHARD_SHUFFLED),
    ("shard_off", """SELECT shard, coalesce(sum(cnt) OVER (ORDER BY shard
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT shard, count(*) AS cnt FROM s GROUP BY shard)"""),
    ("vocab", f"""SELECT piece, token_id FROM (
        SELECT token AS piece, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS token_id
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest({sql_pretok_lower('text')}) AS token
              FROM documents) GROUP BY token)) WHERE token_id < {VOCAB}"""),
    ("tk", f"""SELECT doc_id, sent_idx, k, toks[k] AS tok FROM (
        SELECT doc_id, sent_idx, {sql_pretok_lower('sentence')} AS toks FROM s) x,
        unnest(generate_series(1, len(x.toks))) AS g(k)"""),
    ("enc", """SELECT tk.doc_id, tk.sent_idx, list(coalesce(v.token_id, 0) ORDER BY tk.k) AS raw_ids
        FROM tk LEFT JOIN vocab v ON v.piece = tk.tok GROUP BY tk.doc_id, tk.sent_idx"""),
    ("tokens", f"""SELECT s.shard, CAST(s.pos // {FILE_SIZE} AS INTEGER) AS file_idx,
        CAST(s.pos % {FILE_SIZE} AS BIGINT) AS row, CAST(o.off + s.pos AS BIGINT) AS example_id,
        CAST(s.shard AS VARCHAR) || '/' || CAST(s.pos // {FILE_SIZE} AS VARCHAR) AS rel_path,
        e.raw_ids, list_resize(e.raw_ids, {SEQ_LEN}, 1) AS ids
        FROM s JOIN shard_off o USING (shard) JOIN enc e USING (doc_id, sent_idx)"""),
]
CTE_FILES = CTE_TOKENS + [
    ("manifest", "SELECT rel_path, count(*) AS n_rows FROM tokens GROUP BY rel_path"),
    ("files", f"""SELECT rel_path, n_rows,
        CAST(row_number() OVER (ORDER BY {sql_md5(SEED, 'rel_path')}, rel_path) - 1 AS BIGINT) AS file_rank,
        CAST(coalesce(sum(n_rows) OVER (ORDER BY {sql_md5(SEED, 'rel_path')}, rel_path
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset
        FROM manifest"""),
]


def cte_positions(n_epochs):
    return CTE_FILES + [
        ("ep", f"SELECT t.*, e.epoch FROM tokens t, unnest(range({n_epochs})) AS e(epoch)"),
        ("ranked", f"""SELECT ep.*, CAST(row_number() OVER (PARTITION BY epoch, rel_path
             ORDER BY {sql_md5(SEED, 'epoch', 'rel_path', 'row')}, rel_path, row) - 1 AS BIGINT) AS rank_in_file
             FROM ep"""),
        ("positioned", """SELECT r.*, f.file_offset + r.rank_in_file AS pos
             FROM ranked r JOIN files f USING (rel_path)"""),
    ]


def cte_batches(n_epochs, drop_last=True):
    cond = (f"WHERE p.pos // {BATCH} < n.n_epoch // {BATCH}" if drop_last else "")
    return cte_positions(n_epochs) + [
        ("batches", f"""SELECT p.*, CAST(p.pos // {BATCH} AS BIGINT) AS batch_id,
             CAST(p.pos % {BATCH} AS INTEGER) AS batch_pos
             FROM positioned p JOIN (SELECT epoch, count(*) AS n_epoch FROM positioned GROUP BY epoch) n
             USING (epoch) {cond}"""),
    ]


def sql_ids(col):
    return f"array_to_string({col}, ',')"


def ids_str(col):
    return F.array_join(F.col(col), ",")


def p1_sentences(spark, sf):
    return P1.with_example_ids(P1.shard_sentences(docs(spark, sf), P1.ShardParams(
        n_shards=N_SHARDS, file_size=FILE_SIZE, seq_len=SEQ_LEN)))


def p1_vocab(spark, sf):
    return P1.word_vocab(docs(spark, sf), VOCAB)


_TOKENS: dict = {}


def _app(spark):
    """Memo key of a running application (object ids can be reused)."""
    return spark.sparkContext.applicationId


def p1_tokens(spark, sf, keep_raw=False):
    """P1 output, written once per session and scale below the checkpoint
    folder - the token files that P3 reads - so downstream queries (D5 D6 K*
    M* G3 H6-H9) do not re-run the whole corpus job each time."""
    key = (_app(spark), sf)
    if key not in _TOKENS:
        p = P1.ShardParams(n_shards=N_SHARDS, file_size=FILE_SIZE, seq_len=SEQ_LEN)
        _TOKENS[key] = written(P1.token_table(docs(spark, sf), VOCAB, p, keep_raw=True))
    return _TOKENS[key] if keep_raw else _TOKENS[key].drop("raw_ids")


@query("h6_unknown_mapping", with_ctes(CTE_TOKENS, f"SELECT example_id, {sql_ids('raw_ids')} AS raw_ids FROM tokens"))
def h6_unknown_mapping(spark, sf):
    """H6: sentence pre-tokens -> ids through the vocabulary; unknowns -> [UNK]=0."""
    return p1_tokens(spark, sf, keep_raw=True).select("example_id", ids_str("raw_ids").alias("raw_ids"))


@query("h7_truncate", with_ctes(CTE_TOKENS, f"SELECT example_id, {sql_ids(f'raw_ids[1:{SEQ_LEN}]')} AS ids FROM tokens"))
def h7_truncate(spark, sf):
    """H7: right truncation to the sequence length."""
    t = p1_tokens(spark, sf, keep_raw=True)
    return t.select("example_id", F.array_join(encode.truncate(F.col("raw_ids"), SEQ_LEN), ",").alias("ids"))


@query("h8_pad", with_ctes(CTE_TOKENS, f"SELECT example_id, {sql_ids('ids')} AS ids FROM tokens"))
def h8_pad(spark, sf):
    """H8: truncate then right-pad with [PAD]=1 to exactly 64 ids (the token table)."""
    return p1_tokens(spark, sf).select("example_id", ids_str("ids").alias("ids"))


@query("h9_decode", with_ctes(CTE_TOKENS, """
SELECT t.example_id, coalesce(d.text, '') AS text FROM tokens t LEFT JOIN (
  SELECT x.example_id, string_agg(v.piece, ' ' ORDER BY x.k) AS text
  FROM (SELECT example_id, k, ids[k] AS id FROM tokens, unnest(generate_series(1, len(ids))) AS g(k)) x
  JOIN vocab v ON v.token_id = x.id WHERE x.id >= 3 GROUP BY x.example_id) d USING (example_id)"""))
def h9_decode(spark, sf):
    """H9: ids -> text through the id->piece map (specials skipped)."""
    to_pieces = encode.id_lookup(p1_vocab(spark, sf))
    return p1_tokens(spark, sf).select("example_id", encode.decode(F.col("ids"), to_pieces, sep=" ").alias("text"))


@query("k1_validate_tokens", with_ctes(CTE_TOKENS, f"""
SELECT example_id, reason FROM (
  SELECT example_id, CASE
    WHEN len(raw_ids) <> {SEQ_LEN} AND list_bool_or(list_transform(raw_ids, lambda x: x < 0 OR x >= 1000)) THEN 'width,id_range'
    WHEN len(raw_ids) <> {SEQ_LEN} THEN 'width'
    WHEN list_bool_or(list_transform(raw_ids, lambda x: x < 0 OR x >= 1000)) THEN 'id_range' END AS reason
  FROM tokens) WHERE reason IS NOT NULL"""))
def k1_validate_tokens(spark, sf):
    """K1: untruncated rows checked against width 64 and a 1000-id model vocabulary."""
    t = p1_tokens(spark, sf, keep_raw=True)
    return encode.validate_tokens(t, SEQ_LEN, 1000, "raw_ids").select("example_id", "reason")


@query("d5_file_order", with_ctes(CTE_FILES, "SELECT rel_path, CAST(n_rows AS BIGINT) AS n_rows, file_rank, file_offset FROM files"))
def d5_file_order(spark, sf):
    """Seeded file order of the token files and each file's first position."""
    m = batching.file_manifest(p1_tokens(spark, sf))
    return batching.file_order(m, SEED).select("rel_path", "n_rows", "file_rank", "file_offset")


@query("d6_in_file_shuffle", with_ctes(cte_positions(1), "SELECT example_id, rel_path, rank_in_file, pos FROM positioned"))
def d6_in_file_shuffle(spark, sf):
    """Seeded in-file example order (epoch 0) and the resulting loader position."""
    return batching.epoch_positions(p1_tokens(spark, sf), 1, SEED).select(
        "example_id", "rel_path", "rank_in_file", "pos")


def batches_df(spark, sf, n_epochs=1, drop_last=True):
    pos = batching.epoch_positions(p1_tokens(spark, sf), n_epochs, SEED)
    return batching.assign_batches(pos, BATCH, drop_last)


@query("k2_batches_drop_last", with_ctes(cte_batches(1), "SELECT epoch, batch_id, batch_pos, example_id FROM batches"))
def k2_batches_drop_last(spark, sf):
    """K2: 512-example batches across file borders, trailing partial batch dropped."""
    return batches_df(spark, sf).select("epoch", "batch_id", "batch_pos", "example_id")


@query("k3_batches_keep_last", with_ctes(cte_batches(1, False), "SELECT epoch, batch_id, batch_pos, example_id FROM batches"))
def k3_batches_keep_last(spark, sf):
    """K3: the same batches with the final short batch kept."""
    return batches_df(spark, sf, drop_last=False).select("epoch", "batch_id", "batch_pos", "example_id")


@query("k6_epoch_repeat", with_ctes(cte_batches(2), "SELECT epoch, batch_id, batch_pos, example_id FROM batches"))
def k6_epoch_repeat(spark, sf):
    """K6: two epochs; same file order, fresh in-file order, batch ids restart."""
    return batches_df(spark, sf, 2).select("epoch", "batch_id", "batch_pos", "example_id")


@query("c2_drop_all_pad", with_ctes(cte_batches(1), """
SELECT epoch, batch_id, batch_pos, example_id FROM batches WHERE list_bool_or(list_transform(ids, lambda x: x <> 1))"""))
def c2_drop_all_pad(spark, sf):
    """Batches with all-[PAD] examples removed after batching."""
    return batching.drop_all_pad(batches_df(spark, sf)).select("epoch", "batch_id", "batch_pos", "example_id")


@query("g3_loader_counters", with_ctes(cte_batches(2) + [
    ("per", "SELECT epoch, batch_id, count(*) AS n_examples FROM batches GROUP BY epoch, batch_id")], """
SELECT epoch, batch_id, CAST(n_examples AS BIGINT) AS n_examples,
  CAST(row_number() OVER (PARTITION BY epoch ORDER BY batch_id) AS BIGINT) AS epoch_batches,
  CAST(sum(n_examples) OVER (PARTITION BY epoch ORDER BY batch_id) AS BIGINT) AS epoch_examples,
  CAST(row_number() OVER (ORDER BY epoch, batch_id) AS BIGINT) AS global_batches,
  CAST(sum(n_examples) OVER (ORDER BY epoch, batch_id) AS BIGINT) AS global_examples
FROM per"""))
def g3_loader_counters(spark, sf):
    """Per-batch loader counters (epoch and all-iteration totals) over 2 epochs."""
    return batching.batch_counters(batches_df(spark, sf, 2))


LOADER_BATCH = 900
CTE_LOADER = CTE_FILES + [
    ("fold", f"""SELECT -1::BIGINT AS file_rank, NULL::VARCHAR AS rel_path, 0::BIGINT AS n_rows, 0::BIGINT AS carry_in,
             0::BIGINT AS first_batch, 0::BIGINT AS n_batches, 0::BIGINT AS carry_out
        UNION ALL
        SELECT f.file_rank, f.rel_path, f.n_rows, p.carry_out, p.first_batch + p.n_batches,
               CASE WHEN p.carry_out + f.n_rows < {LOADER_BATCH} THEN 1 ELSE (p.carry_out + f.n_rows) // {LOADER_BATCH} END,
               CASE WHEN p.carry_out + f.n_rows < {LOADER_BATCH} THEN 0 ELSE (p.carry_out + f.n_rows) % {LOADER_BATCH} END
        FROM fold p JOIN files f ON f.file_rank = p.file_rank + 1"""),
    ("loaded", "SELECT * FROM fold WHERE file_rank >= 0"),
]


def with_loader(final):
    return with_ctes(CTE_LOADER, final).replace("WITH ", "WITH RECURSIVE ", 1)


def loader_manifest(spark, sf):
    files_in_order = batching.file_order(batching.file_manifest(p1_tokens(spark, sf)), SEED)
    return batching.loader_files(files_in_order.select("rel_path", "n_rows", "file_rank"), LOADER_BATCH)


@query("k3_loader_batches", with_loader(f"""
SELECT t.example_id, l.first_batch + (l.carry_in + t.row) // {LOADER_BATCH} AS batch_id,
       ((l.carry_in + t.row) % {LOADER_BATCH})::INTEGER AS batch_pos
FROM tokens t JOIN loaded l USING (rel_path)"""))
def k3_loader_batches(spark, sf):
    """K3 as the one-file-at-a-time loader cuts batches of 900: a file that fills none gives out a short one."""
    rows = p1_tokens(spark, sf).withColumn("rank_in_file", F.col("row"))
    out = batching.loader_batches(rows, loader_manifest(spark, sf), LOADER_BATCH)
    return out.select("example_id", "batch_id", "batch_pos")


@query("g3_file_counters", with_loader(f"""
SELECT batch_id, file_idx, row_number() OVER (PARTITION BY f ORDER BY batch_id) AS file_batches,
       sum(n_examples) OVER (PARTITION BY f ORDER BY batch_id)::BIGINT AS file_examples, n_examples
FROM (SELECT b.batch_id, coalesce(l.file_rank, (SELECT count(*) FROM loaded)) AS file_idx,
             coalesce(l.file_rank, (SELECT count(*) - 1 FROM loaded)) AS f, b.n_examples
      FROM (SELECT l.first_batch + (l.carry_in + t.row) // {LOADER_BATCH} AS batch_id, count(*) AS n_examples
            FROM tokens t JOIN loaded l USING (rel_path) GROUP BY 1) b
      LEFT JOIN loaded l ON b.batch_id >= l.first_batch AND b.batch_id < l.first_batch + l.n_batches)"""))
def g3_file_counters(spark, sf):
    """Batches and examples that the current file has given out, at every batch."""
    return batching.file_counters(loader_manifest(spark, sf), LOADER_BATCH)


@query("k7_missing_files", with_ctes(CTE_FILES, """
SELECT rel_path FROM manifest WHERE rel_path NOT IN (SELECT rel_path FROM manifest WHERE NOT starts_with(rel_path, '0/'))"""))
def k7_missing_files(spark, sf):
    """K7: files of the saved state that a listing of the token folder no longer
    finds; shard 0 was never written there."""
    tokens = p1_tokens(spark, sf)
    base = _scratch(spark, "listing")
    files.write_token_shards(tokens.where("shard <> 0"), f"{base}/tokens")
    found = files.list_files(spark, f"{base}/tokens", ".parquet")
    listing = found.select(F.regexp_replace(
        F.regexp_extract("path", r"(shard=\d+/file_idx=\d+)/[^/]+$", 1), r"[a-z_]+=", "").alias("rel_path"))
    return batching.missing_files(batching.file_manifest(tokens), listing.distinct()).select("rel_path")


def sql_mask(cfg: masking.MaskConfig, vocab_high: int, ctes=None):
    use_random = not (cfg.prop_random == 0 or cfg.prop_mask == 1)
    pr = cfg.prop_random / (1 - cfg.prop_mask) if use_random else 0.0
    h = f"md5(concat_ws(':', '{cfg.seed}', CAST(epoch AS VARCHAR), CAST(example_id AS VARCHAR), CAST(i - 1 AS VARCHAR)))"

    def u(k):
        return f"(CAST(('0x' || substr({h}, {8 * (k - 1) + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
    sel = f"(x <> {cfg.pad_id} AND {u(1)} < {cfg.mask_prob}::DOUBLE)"
    to_mask = f"({sel} AND {u(2)} < {cfg.prop_mask}::DOUBLE)"
    rnd = (f"WHEN {sel} AND NOT {to_mask} AND {u(3)} < {pr!r}::DOUBLE "
           f"THEN CAST({cfg.vocab_low} + floor({u(4)} * {vocab_high - cfg.vocab_low}) AS INTEGER) "
           if use_random else "")
    masked = f"list_transform(ids, lambda x, i: CASE WHEN {to_mask} THEN {cfg.mask_id} {rnd}ELSE x END)"
    selected = f"list_transform(ids, lambda x, i: CASE WHEN {sel} THEN 1 ELSE 0 END)"
    att = f"list_transform(ids, lambda x: CASE WHEN x <> {cfg.pad_id} THEN 1 ELSE 0 END)"
    return with_ctes(ctes or cte_batches(1), f"""
SELECT epoch, batch_id, batch_pos, example_id, {sql_ids(masked)} AS masked_ids,
       {sql_ids(selected)} AS selected, {sql_ids(att)} AS attention_mask FROM batches""")


def mask_query(cfg: masking.MaskConfig):
    def run(spark, sf):
        m = masking.mask_batches(batches_df(spark, sf), cfg)
        return m.select("epoch", "batch_id", "batch_pos", "example_id",
                        ids_str("masked_ids").alias("masked_ids"),
                        F.array_join(F.transform("selected", lambda b: b.cast("int")), ",").alias("selected"),
                        ids_str("attention_mask").alias("attention_mask"))
    return run


MASK_CONFIGS = {
    "m6_mask_batches": masking.MaskConfig(vocab_high=VOCAB),                        # 0.15 / 0.8 / 0.1
    "m1_select_only": masking.MaskConfig(prop_mask=0.0, prop_random=0.0, vocab_high=VOCAB),
    "m2_replace_with_mask": masking.MaskConfig(mask_prob=0.5, prop_mask=1.0, prop_random=0.0, vocab_high=VOCAB),
    "m3_replace_random": masking.MaskConfig(mask_prob=0.5, prop_mask=0.5, prop_random=0.5, vocab_high=VOCAB),
    "m4_keep_unchanged": masking.MaskConfig(mask_prob=1.0, prop_mask=0.0, prop_random=0.0, vocab_high=VOCAB),
    "m5_attention_only": masking.MaskConfig(mask_prob=0.0, vocab_high=VOCAB),
}
for _name, _cfg in MASK_CONFIGS.items():
    query(_name, sql_mask(_cfg, VOCAB))(mask_query(_cfg))


# =========================== I, F6, F7: evaluation on embeddings ===========
from lexforge.operators import evaluate, runlog  # noqa: E402


def predictions(spark, sf):
    """embeddings as a prediction table: embedding = logits, label = truth,
    15% of the positions selected by a seeded hash, as masking does."""
    selected = hex_uniform(hash_key("select", "vec_id"), 1) < 0.15
    return read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("logits"), "label", selected.alias("selected"))


SQL_SELECTED = """(SELECT CAST(embedding AS DOUBLE[]) AS l, label FROM embeddings
   WHERE ('0x' || substr(md5('select:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15::DOUBLE)"""


SQL_CE_ROWS = """SELECT list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1] AS ce
  FROM """ + SQL_SELECTED


@query("i1_masked_cross_entropy", f"""
SELECT round(avg(ce), 6) AS cross_entropy, CAST(count(*) AS BIGINT) AS n_scored FROM ({SQL_CE_ROWS})""")
def i1_masked_cross_entropy(spark, sf):
    """Mean cross-entropy over selected positions (max-shifted logsumexp)."""
    r = evaluate.masked_cross_entropy(predictions(spark, sf))
    return r.select(F.round("cross_entropy", 6).alias("cross_entropy"), "n_scored")


@query("i2_masked_nll", f"""
SELECT round(avg(-ln(exp(l[label + 1]) / list_sum(list_transform(l, lambda x: exp(x))))), 6) AS nll
FROM {SQL_SELECTED}""")
def i2_masked_nll(spark, sf):
    """Mean negative log-likelihood through an explicit softmax."""
    return evaluate.masked_nll(predictions(spark, sf)).select(F.round("nll", 6).alias("nll"))


@query("i3_mean_probability", f"SELECT round(exp(-avg(ce)), 6) AS probability FROM ({SQL_CE_ROWS})")
def i3_mean_probability(spark, sf):
    """exp(-loss), the logged mean token probability."""
    r = evaluate.masked_cross_entropy(predictions(spark, sf))
    return r.select(F.round("probability", 6).alias("probability"))


@query("f6_vector_stats", """
SELECT 'class_' || CAST(label AS VARCHAR) AS name, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(sqrt(sum(x * x)), 6) AS l2_norm
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label""")
def f6_vector_stats(spark, sf):
    """mean, sample std and L2 norm per named vector group (prefix-filtered)."""
    v = read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("name"), "embedding")
    r = evaluate.vector_stats(v, "name", "embedding", prefixes=["class_"])
    return r.select("name", *[F.round(c, 6).alias(c) for c in ("mean", "std", "l2_norm")])


@query("f7_nan_audit", """
SELECT 'class_' || CAST(label AS VARCHAR) AS name,
       CAST(sum(len(list_filter(embedding, lambda x: isnan(x)))) AS BIGINT) AS n_nan,
       CAST(sum(len(embedding)) AS BIGINT) AS n_total,
       round(sum(len(list_filter(embedding, lambda x: isnan(x)))) / sum(len(embedding)), 6) AS nan_ratio,
       sum(len(list_filter(embedding, lambda x: isnan(x)))) > 0 AS has_nan
FROM embeddings GROUP BY label""")
def f7_nan_audit(spark, sf):
    """NaN count, total, ratio and any-flag per named vector group."""
    v = read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("name"), "embedding")
    r = evaluate.nan_audit(v, "name", "embedding")
    return r.select("name", "n_nan", "n_total", F.round("nan_ratio", 6).alias("nan_ratio"), "has_nan")


# =========================== G2, G4, C5, C6, F8, J: run logs ===============
EXAMPLES_PER_STEP = 512
STEPS_PER_EPOCH = 50


def run_events(spark, sf):
    """events as a run log without counters: run = user, loss = value,
    checkpoint = purchase, 512 examples per step."""
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"), "event_id", "ts",
        F.col("value").alias("loss"), (F.col("event_type") == "purchase").alias("is_checkpoint"),
        F.lit(EXAMPLES_PER_STEP).cast("long").alias("examples"))


def run_log(spark, sf):
    """The run log with step/epoch from the library's running ranks."""
    return runlog.steps(run_events(spark, sf), "run", steps_per_epoch=STEPS_PER_EPOCH)


def run_progress(spark, sf, gap_s=None):
    return runlog.progress(run_events(spark, sf), steps_per_epoch=STEPS_PER_EPOCH, gap_s=gap_s)


CTE_RUNLOG = [
    ("rl", f"""SELECT 'run_' || CAST(user_id AS VARCHAR) AS run, event_id, ts, value AS loss,
        event_type = 'purchase' AS is_checkpoint, CAST({EXAMPLES_PER_STEP} AS BIGINT) AS examples,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step
        FROM events"""),
    ("rl2", f"SELECT *, CAST(floor(step / {STEPS_PER_EPOCH}) AS INTEGER) AS epoch FROM rl"),
    ("g", """SELECT *, CAST(row_number() OVER (PARTITION BY run, epoch ORDER BY step) AS BIGINT) AS epoch_batches,
        CAST(sum(examples) OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch_examples,
        CAST(step + 1 AS BIGINT) AS global_batches,
        CAST(sum(examples) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS global_examples
        FROM rl2"""),
]


@query("g2_running_counters", with_ctes(CTE_RUNLOG, """
SELECT run, step, epoch, epoch_batches, epoch_examples, global_batches, global_examples FROM g"""))
def g2_running_counters(spark, sf):
    """epoch/global batch and example counters after every step."""
    r = run_progress(spark, sf)
    return r.select("run", "step", "epoch", "epoch_batches", "epoch_examples", "global_batches", "global_examples")


@query("g4_checkpoint_deltas", with_ctes(CTE_RUNLOG + [
    ("x", """SELECT *, coalesce(sum(examples) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ex_before FROM rl2"""),
    ("y", """SELECT *, max(CASE WHEN is_checkpoint THEN step + 1 END) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_b,
        max(CASE WHEN is_checkpoint THEN ex_before + examples END) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_e FROM x""")], """
SELECT run, step, CAST(step AS BIGINT) AS session_batches, CAST(ex_before AS BIGINT) AS session_examples,
       CAST(step - coalesce(last_b, 0) AS BIGINT) AS checkpoint_batches,
       CAST(ex_before - coalesce(last_e, 0) AS BIGINT) AS checkpoint_examples FROM y"""))
def g4_checkpoint_deltas(spark, sf):
    """batches/examples this session (all of the run) and since the last checkpoint."""
    r = run_progress(spark, sf)
    return r.select("run", "step", "session_batches", "session_examples", "checkpoint_batches",
                    "checkpoint_examples")


SESSION_GAP_S = 86_400
CTE_SESSIONS = CTE_RUNLOG + [
    ("s0", f"""SELECT *, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > {SESSION_GAP_S * 1_000_000}, true) AS begins
        FROM rl2 WINDOW w AS (PARTITION BY run ORDER BY step)"""),
    ("s1", """SELECT *, sum(begins::INT) OVER (PARTITION BY run ORDER BY step) - 1 AS session,
        coalesce(sum(examples) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM s0"""),
    ("s2", """SELECT *, first_value(struct_pack(b := step, e := before, us := us)) OVER (PARTITION BY run, session ORDER BY step) AS s,
        max(CASE WHEN is_checkpoint THEN struct_pack(b := step + 1, e := before + examples, us := us) END)
            OVER (PARTITION BY run, session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM s1"""),
]


@query("g4_session_progress", with_ctes(CTE_SESSIONS, """
SELECT run, step, session::BIGINT AS session, (step - s.b)::BIGINT AS session_batches, (before - s.e)::BIGINT AS session_examples,
       (step - coalesce(c.b, s.b))::BIGINT AS checkpoint_batches, (before - coalesce(c.e, s.e))::BIGINT AS checkpoint_examples,
       round((us - s.us) / 1e6, 6) AS session_s, round((us - coalesce(c.us, s.us)) / 1e6, 6) AS checkpoint_s,
       before::BIGINT AS total_examples FROM s2"""))
def g4_session_progress(spark, sf):
    """G4 over restarts: a session ends after a day without a step; counters since its
    begin and since its last checkpoint, beside the totals carried over sessions."""
    r = run_progress(spark, sf, SESSION_GAP_S)
    return r.select("run", "step", "session", "session_batches", "session_examples", "checkpoint_batches",
                    "checkpoint_examples", F.round("session_s", 6).alias("session_s"),
                    F.round("checkpoint_s", 6).alias("checkpoint_s"), "total_examples")


@query("f8_session_throughput", with_ctes(CTE_SESSIONS + [
    ("o", """SELECT run, session, count(*) AS b, sum(examples) AS e, (max(us) - min(us)) / 1e6 AS el FROM s1 GROUP BY run, session"""),
    ("t", """SELECT *, sum(b) OVER w AS tb, sum(e) OVER w AS te, sum(el) OVER w AS tel FROM o
        WINDOW w AS (PARTITION BY run ORDER BY session)""")], """
SELECT run, session::BIGINT AS session, b::BIGINT AS session_batches, e::BIGINT AS session_examples, round(el, 6) AS session_s,
       tb::BIGINT AS total_batches, te::BIGINT AS total_examples, round(tel, 6) AS total_s,
       trunc(CASE WHEN el > 0 THEN e / el END)::BIGINT AS session_examples_per_s, round(el / b + 1e-9, 6) AS session_s_per_batch,
       trunc(CASE WHEN tel > 0 THEN te / tel END)::BIGINT AS total_examples_per_s, round(tel / tb + 1e-9, 6) AS total_s_per_batch FROM t"""))
def f8_session_throughput(spark, sf):
    """F8 over restarts: rates of each session and of all sessions so far."""
    r = runlog.session_throughput(run_progress(spark, sf, SESSION_GAP_S))
    # halves of microseconds are moved off the edge that engines round differently
    return r.select(*[F.round(F.col(c) + (1e-9 if c.endswith("batch") else 0.0), 6).alias(c) if t == "double" else F.col(c)
                      for c, t in r.dtypes])


@query("c5_log_every_n", with_ctes(CTE_RUNLOG, "SELECT run, step FROM rl2 WHERE step % 10 = 0"))
def c5_log_every_n(spark, sf):
    """Steps that are logged when logging every 10 batches."""
    return runlog.log_due(run_log(spark, sf), 10).select("run", "step")


@query("c6_checkpoint_due", with_ctes(CTE_RUNLOG, "SELECT run, step FROM rl2 WHERE (step + 1) % 20 = 0 AND step + 1 > 0"))
def c6_checkpoint_due(spark, sf):
    """Steps after which a checkpoint is due (every 20 batches)."""
    return runlog.checkpoint_due(run_log(spark, sf), 20).select("run", "step")


@query("j1_lr_schedule", with_ctes(CTE_RUNLOG, """
SELECT run, step, round(pow(512.0, -0.5) * least(pow(step + 1, -0.5), (step + 1) * pow(10000.0, -1.5)), 12) AS lr
FROM rl2"""))
def j1_lr_schedule(spark, sf):
    """Learning-rate column (d_model 512, 10,000 warm-up steps)."""
    r = run_log(spark, sf)
    return r.select("run", "step", F.round(runlog.learning_rate("step"), 12).alias("lr"))


@query("f8_throughput", with_ctes(CTE_RUNLOG + [
    ("u", "SELECT run, step, epoch_us(ts) AS us, examples, is_checkpoint FROM rl2"),
    ("b", """SELECT run, min(us) AS t0, max(us) AS t1, coalesce(max(step) FILTER (is_checkpoint), -1) AS ck,
        coalesce(arg_max(us, step) FILTER (is_checkpoint), min(us)) AS tc FROM u GROUP BY run"""),
    ("sc", """SELECT u.run, s.scope, count(*) AS batches, sum(examples) AS n_examples,
        (max(b.t1) - max(b.t0)) / 1e6 AS el FROM u JOIN b USING (run), (SELECT unnest(['session', 'total']) AS scope) s
        GROUP BY u.run, s.scope
        UNION ALL
        SELECT u.run, 'since_checkpoint' AS scope, count(*) FILTER (step > b.ck) AS batches,
        coalesce(sum(examples) FILTER (step > b.ck), 0) AS n_examples,
        (max(b.t1) - max(b.tc)) / 1e6 AS el FROM u JOIN b USING (run) GROUP BY u.run""")], """
SELECT run, scope, CAST(batches AS BIGINT) AS batches, CAST(n_examples AS BIGINT) AS n_examples,
       round(el, 6) AS elapsed_s,
       round(CASE WHEN el = 0 THEN NULL ELSE batches / el END, 6) AS batches_per_s,
       CAST(trunc(CASE WHEN el = 0 THEN NULL ELSE n_examples / el END) AS BIGINT) AS examples_per_s,
       round(CASE WHEN batches = 0 THEN 0 ELSE el / batches END, 6) AS s_per_batch FROM sc"""))
def f8_throughput(spark, sf):
    """F8: batches/s, examples/s, s/batch per run: session, total and since checkpoint."""
    r = runlog.throughput(run_log(spark, sf))
    return r.select("run", "scope", "batches", "n_examples",
                    *[F.round(c, 6).alias(c) for c in ("elapsed_s", "batches_per_s")],
                    "examples_per_s", F.round("s_per_batch", 6).alias("s_per_batch"))


def checkpoint_files(spark, sf):
    """Checkpoint files a run would have written: one per checkpoint step
    (``ckpt/``) and one per finished epoch (``ckpt/epoch/``, epoch + 1, batch 0)."""
    g = run_progress(spark, sf)
    step_ck = g.where("is_checkpoint").select(
        "run", F.concat(F.lit("ckpt/"), runlog.checkpoint_name(F.col("run"), F.col("epoch"),
                                                                F.col("epoch_batches"))).alias("path"),
        F.col("ts").alias("ctime"))
    ep = g.groupBy("run", "epoch").agg(F.max("ts").alias("ctime"))
    ep_ck = ep.select("run", F.concat(F.lit("ckpt/epoch/"), runlog.checkpoint_name(
        F.col("run"), F.col("epoch") + 1, F.lit(0))).alias("path"), "ctime")
    return step_ck.unionByName(ep_ck)


SQL_CKPT_RE = r"^(?:(.*)/)?([^/]+)_epoch(\d+)_batch(\d+)\.pt$"
CTE_CKPT = CTE_RUNLOG + [
    ("files", """SELECT run, 'ckpt/' || run || '_epoch' || CAST(epoch AS VARCHAR) || '_batch'
            || CAST(epoch_batches AS VARCHAR) || '.pt' AS path, ts AS ctime FROM g WHERE is_checkpoint
        UNION ALL
        SELECT run, 'ckpt/epoch/' || run || '_epoch' || CAST(epoch + 1 AS VARCHAR) || '_batch0.pt' AS path,
            max(ts) AS ctime FROM g GROUP BY run, epoch"""),
    ("manifest", f"""SELECT path, ctime, regexp_extract(path, '{SQL_CKPT_RE}', 2) AS ckpt_run,
        CAST(regexp_extract(path, '{SQL_CKPT_RE}', 3) AS INTEGER) AS ckpt_epoch,
        CAST(regexp_extract(path, '{SQL_CKPT_RE}', 4) AS BIGINT) AS ckpt_batch,
        CASE WHEN regexp_matches(path, '(^|/)epoch/[^/]+$') THEN 'epoch' ELSE 'step' END AS kind
        FROM files"""),
]


def ckpt_manifest(spark, sf):
    return runlog.parse_checkpoint_paths(checkpoint_files(spark, sf))


@query("j4_checkpoint_manifest", with_ctes(CTE_CKPT, "SELECT path, ckpt_run, ckpt_epoch, ckpt_batch, kind FROM manifest"))
def j4_checkpoint_manifest(spark, sf):
    """Run, epoch, batch and kind parsed from checkpoint file paths."""
    return ckpt_manifest(spark, sf).select("path", "ckpt_run", "ckpt_epoch", "ckpt_batch", "kind")


@query("j6_resume_point", with_ctes(CTE_CKPT, """
SELECT ckpt_run, path, ckpt_epoch AS epoch, ckpt_batch AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY ckpt_run ORDER BY ckpt_epoch DESC, ckpt_batch DESC, path DESC) AS r
  FROM manifest) WHERE r = 1"""))
def j6_resume_point(spark, sf):
    """The checkpoint each run resumes from (latest epoch, then batch)."""
    return runlog.resume_point(ckpt_manifest(spark, sf))


@query("j7_retention", with_ctes(CTE_CKPT, """
SELECT path, CASE WHEN row_number() OVER (PARTITION BY ckpt_run ORDER BY ctime DESC, path DESC) - 1 < 5
                  THEN 'keep' ELSE 'expire' END AS action FROM manifest"""))
def j7_retention(spark, sf):
    """keep/expire flags when at most 5 checkpoints are retained per run."""
    return runlog.retention(ckpt_manifest(spark, sf), 5).select("path", "action")


# =========================== F3, D9, H1-H5, F4: BPE ========================
from lexforge.operators import bpe, dictionary  # noqa: E402

SQL_COVERAGE = f"SELECT word, n FROM ({SQL_RANKED}) WHERE n_before * 1000000 < 900000 * total"
CTE_PAIRS = [
    ("cov", SQL_COVERAGE),
    ("sy", "SELECT word, n, list_concat(regexp_extract_all(word, '(?s).'), [' ']) AS s FROM cov"),
    ("pr", "SELECT n, s[i] AS l, s[i + 1] AS r FROM sy, unnest(generate_series(1, len(s) - 1)) AS g(i)"),
    ("pc", "SELECT l, r, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY l, r"),
]


def coverage_words(spark, sf):
    """G1 output as the BPE word table ``(word, freq)``."""
    return vocab.coverage_cut(vocab.word_counts(docs(spark, sf))).select("word", F.col("n").alias("freq"))


def coverage_symbol_pairs(spark, sf):
    w = coverage_words(spark, sf).withColumn("sym", tx.end_of_word_symbols("word", " "))
    return bpe.pair_counts(w).select(F.col("a").alias("left_sym"), F.col("b").alias("right_sym"), "n")


@query("f3_pair_counts", with_ctes(CTE_PAIRS, "SELECT l AS left_sym, r AS right_sym, n FROM pc"))
def f3_pair_counts(spark, sf):
    """adjacent symbol pairs of the 90%-coverage words, weighted by count."""
    return coverage_symbol_pairs(spark, sf)


@query("d9_top_pairs", with_ctes(CTE_PAIRS, "SELECT l AS left_sym, r AS right_sym, n FROM pc ORDER BY n DESC, l, r LIMIT 10"))
def d9_top_pairs(spark, sf):
    """The 10 most frequent pairs (ties by symbols) - distributed top-k."""
    p = coverage_symbol_pairs(spark, sf)
    return p.orderBy(F.col("n").desc(), "left_sym", "right_sym").limit(10)


@query("h3_apply_merge", with_ctes(CTE_PAIRS + [
    ("t", "SELECT l, r FROM pc ORDER BY n DESC, l, r LIMIT 1"),
    ("st", """SELECT word, s, list_transform(s, lambda x, i: coalesce(i < len(s) AND x = t.l AND s[i + 1] = t.r, false))
              AS starts FROM sy, t""")], """
SELECT word, array_to_string(list_filter(list_transform(s, lambda x, i:
         CASE WHEN starts[i] THEN x || t.r WHEN i > 1 AND starts[i - 1] THEN NULL ELSE x END),
         lambda y: y IS NOT NULL), '|') AS symbols
FROM st, t"""))
def h3_apply_merge(spark, sf):
    """H3: the most frequent pair merged left to right in every coverage word."""
    top = d9_top_pairs(spark, sf).first()           # one pair (top-1)
    w = coverage_words(spark, sf).withColumn("sym", tx.end_of_word_symbols("word", " "))
    merged = bpe.apply_merges(F.col("sym"), [(top.left_sym, top.right_sym, top.left_sym + top.right_sym)])
    return w.select("word", F.array_join(merged, "|").alias("symbols"))


def _alphabet_values():
    return ", ".join(f"(chr({ord(c)}))" for c in sorted(set(tx.ALPHABET)))


@query("f4_alphabet", f"""
WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(tok, '(?s).')) AS ch
             FROM (SELECT unnest({sql_pretok_lower('text')}) AS tok FROM documents)) GROUP BY ch),
     a AS (SELECT col0 AS ch, true AS in_alphabet FROM (VALUES {_alphabet_values()})),
     u AS (SELECT coalesce(c.ch, a.ch) AS ch, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
                  coalesce(a.in_alphabet, false) AS in_alphabet FROM c FULL OUTER JOIN a ON c.ch = a.ch)
SELECT ch, n, in_alphabet, row_number() OVER (ORDER BY in_alphabet DESC, n DESC, ch) <= 74 AS kept FROM u""")
def f4_alphabet(spark, sf):
    """character counts of the lower-cased pre-tokens plus the fixed
    74-character alphabet; the first 74 (alphabet first) are kept."""
    toks = docs(spark, sf).select(F.explode(P1.word_tokens("text")).alias("word"))
    return vocab.alphabet(toks, tx.ALPHABET, 74)


H2_MERGES = 10_000
H1_VOCAB = 15_000
_MODELS: dict = {}


def library_words(spark, sf):
    """E3 -> E4 -> F1: normalised, pre-tokenised word counts of all documents."""
    normed = tx.normalize_rows(docs(spark, sf), "text", "norm")
    return vocab.word_counts(normed, words=tx.pretokenize("norm")).select("word", F.col("n").alias("freq"))


def library_model(spark, sf):
    """H1 model, trained once per session and scale (a tokenizer artifact)."""
    key = (_app(spark), sf, H1_VOCAB)
    if key not in _MODELS:
        _MODELS[key] = bpe.train_library(library_words(spark, sf), H1_VOCAB, min_frequency=5)
    return _MODELS[key]


@query("h2_bpe_train_handwritten")
def h2_bpe_train_handwritten(spark, sf):
    """H2: 10,000 exact BPE merges (or all there are) on the 90%-coverage words (space end marker)."""
    m = bpe.train_space(coverage_words(spark, sf), H2_MERGES)
    return bpe.merges_frame(spark, m)


@query("h1_bpe_train_library")
def h1_bpe_train_library(spark, sf):
    """H1: library-style BPE (74-char alphabet, </w>, min pair count 5, vocab 15,000)."""
    return bpe.merges_frame(spark, library_model(spark, sf))


@query("h4_vocab_assembly")
def h4_vocab_assembly(spark, sf):
    """H4: specials, alphabet, suffixed characters and merges with their ids."""
    return bpe.vocab_frame(spark, library_model(spark, sf), H1_VOCAB)


@query("h5_encode_bpe")
def h5_encode_bpe(spark, sf):
    """H5-H8: sentences encoded with the trained BPE model, truncated and padded to 64."""
    s = sentences.split_sentences(docs(spark, sf)).withColumn("words", tx.pretokenize(tx.normalize("sentence")))
    s = written(s.select("doc_id", "sent_idx", "words"))
    ids = dictionary.build(s, F.col("words"), library_model(spark, sf))
    out = dictionary.encode(s, "words", ids, ["doc_id", "sent_idx"])
    drop_written(s)
    return out.select("doc_id", "sent_idx", F.array_join(encode.fixed_length(F.col("raw_ids"), SEQ_LEN), ",").alias("ids"))


# --------------------------------------------------------------------------
# The same tokenizer chain trained on the benchmark texts: few enough words for
# SQL to train, too (one merge a step, all words as one list of marked strings),
# and used on all documents.
BENCH_VOCAB = 300
BENCH_MERGES = 150
SQL_ALPHABET = "[" + ", ".join(f"chr({ord(c)})" for c in sorted(set(tx.ALPHABET))) + "]"
SQL_SYMBOLS = "array_to_string(list_transform({0}, lambda c: chr(1) || c || chr(2)), '')"
SQL_WORDS_LIBRARY = f"""SELECT word, count(*) AS freq FROM (SELECT unnest({SQL_PRETOKEN.replace("text,", "x,", 1)}) AS word
    FROM (SELECT {SQL_NORM} AS x FROM benchmark)) GROUP BY word"""
SQL_WORDS_SPACE = SQL_WC.replace("documents", "benchmark").replace("AS n FROM", "AS freq FROM")


def cte_training(library):
    """CTEs up to ``t``: the state before each merge and the merge that led to it."""
    stop, least = (f"len(pieces) < {BENCH_VOCAB}", 5) if library else (f"step < {BENCH_MERGES}", 1)
    chars = [("chars", """SELECT word, freq, list_transform(string_split(word, ''), lambda c: c) AS cs FROM words""")]
    if library:
        start = [
            ("kept", f"""SELECT word, freq, list_filter(list_transform(cs, lambda c, i: CASE WHEN i < len(cs) THEN c ELSE c || '</w>' END),
                lambda c: list_contains({SQL_ALPHABET}, c[1])) AS syms FROM chars"""),
            ("start", f"""SELECT ['[UNK]', '[PAD]', '[MASK]'] || {SQL_ALPHABET} || list_sort(coalesce(list(DISTINCT cs[-1] || '</w>')
                FILTER (list_contains({SQL_ALPHABET}, cs[-1])), [])) AS pieces FROM chars""")]
    else:
        start = [("kept", "SELECT word, freq, list_append(cs, ' ') AS syms FROM chars"),
                 ("start", "SELECT list_sort(list(DISTINCT c)) AS pieces FROM (SELECT unnest(syms) AS c FROM kept)")]
    return [("words", SQL_WORDS_LIBRARY if library else SQL_WORDS_SPACE), *chars, *start, ("t", f"""
      SELECT 0 AS step, pieces, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::BIGINT AS n,
             (SELECT list(struct_pack(s := {SQL_SYMBOLS.format('syms')}, f := freq)) FROM kept WHERE len(syms) > 1) AS ws
      FROM start
      UNION ALL
      SELECT step + 1, CASE WHEN list_contains(pieces, best.l || best.r) THEN pieces ELSE list_append(pieces, best.l || best.r) END,
             best.l, best.r, best.n, list_transform(ws, lambda x: struct_pack(
                 s := replace(x.s, chr(1) || best.l || chr(2) || chr(1) || best.r || chr(2), chr(1) || best.l || best.r || chr(2)), f := x.f))
      FROM t, LATERAL (SELECT l, r, sum(f)::BIGINT AS n
           FROM (SELECT f, p[i] AS l, p[i + 1] AS r FROM (SELECT f, p, unnest(range(1, len(p))) AS i FROM (
                 SELECT u.f AS f, string_split(substr(u.s, 2, len(u.s) - 2), chr(2) || chr(1)) AS p FROM (SELECT unnest(ws) AS u))))
           GROUP BY l, r ORDER BY n DESC, list_position(pieces, l), list_position(pieces, r) LIMIT 1) best
      WHERE {stop} AND best.n >= {least}""")]


def with_training(ctes, final, library=True):
    return with_ctes(cte_training(library) + ctes, final).replace("WITH ", "WITH RECURSIVE ", 1)


SQL_MERGES = """SELECT (step - 1)::INTEGER AS rank, l AS "left", r AS "right", l || r AS merged, n FROM t WHERE step > 0"""
CTE_BPE_TOKENS = [
    *[c for c in CTE_TOKENS if c[0] in ("s", "shard_off")],
    ("pieces", "SELECT pieces FROM t ORDER BY step DESC LIMIT 1"),
    ("merge_list", """SELECT coalesce(list(chr(1) || l || chr(2) || chr(1) || r || chr(2) ORDER BY step), []) AS ms
        FROM t WHERE step > 0"""),
    ("sw", f"""SELECT shard, doc_id, sent_idx, pos, {SQL_PRETOKEN.replace("text,", "x,", 1)} AS ws
        FROM (SELECT *, {SQL_NORM.replace("(text,", "(sentence,")} AS x FROM s)"""),
    ("dict", """SELECT word, list_transform(string_split(substr(y, 2, len(y) - 2), chr(2) || chr(1)),
            lambda c: coalesce(list_position(pieces, c) - 1, 0)) AS word_ids
        FROM (SELECT word, pieces, list_reduce(list_prepend(array_to_string(list_transform(string_split(word, ''),
                lambda c, i: chr(1) || c || CASE WHEN i < len(word) THEN '' ELSE '</w>' END || chr(2)), ''), ms),
                lambda y, m: replace(y, m, replace(m, chr(2) || chr(1), ''))) AS y
              FROM (SELECT DISTINCT unnest(ws) AS word FROM sw), merge_list, pieces)"""),
    ("enc", """SELECT doc_id, sent_idx, flatten(list(word_ids ORDER BY k)) AS raw_ids
        FROM (SELECT doc_id, sent_idx, ws, unnest(range(1, len(ws) + 1)) AS k FROM sw) x JOIN dict ON dict.word = x.ws[x.k]
        GROUP BY doc_id, sent_idx"""),
    ("tokens", f"""SELECT s.shard, CAST(s.pos // {FILE_SIZE} AS INTEGER) AS file_idx,
        CAST(s.pos % {FILE_SIZE} AS BIGINT) AS row, CAST(o.off + s.pos AS BIGINT) AS example_id,
        coalesce(e.raw_ids, []) AS raw_ids, list_resize(coalesce(e.raw_ids, []), {SEQ_LEN}, 1) AS ids
        FROM s JOIN shard_off o USING (shard) LEFT JOIN enc e USING (doc_id, sent_idx)"""),
]


def bench_words(spark, sf, library):
    texts = read_table(spark, sf, "benchmark").select("text")
    if library:
        texts = tx.normalize_rows(texts, "text", "norm")
        counts = vocab.word_counts(texts, words=tx.pretokenize("norm"))
    else:
        counts = vocab.word_counts(texts)
    return counts.select("word", F.col("n").alias("freq"))


def bench_model(spark, sf):
    """The benchmark tokenizer, trained once per session and scale."""
    key = (_app(spark), sf, "benchmark")
    if key not in _MODELS:
        _MODELS[key] = bpe.train_library(bench_words(spark, sf, True), BENCH_VOCAB, min_frequency=5)
    return _MODELS[key]


@query("h1_bpe_train_benchmark", with_training([], SQL_MERGES))
def h1_bpe_train_benchmark(spark, sf):
    """H1 on the words of the benchmark texts: </w> suffix, pairs that count 5, 300 ids."""
    return bpe.merges_frame(spark, bench_model(spark, sf))


@query("h2_bpe_train_benchmark", with_training([], SQL_MERGES, library=False))
def h2_bpe_train_benchmark(spark, sf):
    """H2 on the words of the benchmark texts: space end marker, 150 merges."""
    return bpe.merges_frame(spark, bpe.train_space(bench_words(spark, sf, False), BENCH_MERGES))


class _Killed(Exception):
    pass


@query("b6_merge_log", with_training([], SQL_MERGES, library=False))
def b6_merge_log(spark, sf):
    """Merges appended while training; the run is ended after two rounds, a
    second one goes on from the log; the log read back."""
    log = _scratch(spark, "merges")

    def end(rounds, *_):
        if rounds == 2:
            raise _Killed
    words = bench_words(spark, sf, False)
    try:
        bpe.train_space(words, BENCH_MERGES, k=8, on_round=end, log=log, log_every=10)
    except _Killed:
        pass
    bpe.train_space(words, BENCH_MERGES, log=log, log_every=10)
    return bpe.read_merge_log(spark, log)


@query("h4_vocab_benchmark", with_training([("pieces", "SELECT pieces FROM t ORDER BY step DESC LIMIT 1")], f"""
SELECT (i - 1)::INTEGER AS token_id, pieces[i] AS piece, CASE WHEN i <= 3 THEN 'special'
       WHEN i <= 3 + len({SQL_ALPHABET}) THEN 'alphabet' WHEN i <= (SELECT len(pieces) FROM start) THEN 'suffixed'
       ELSE 'merge' END AS kind, {SEQ_LEN} AS seq_len
FROM (SELECT pieces, unnest(range(1, len(pieces) + 1)) AS i FROM pieces)"""))
def h4_vocab_benchmark(spark, sf):
    """H4 + B7 + A5: the benchmark tokenizer saved and loaded; its vocabulary."""
    base = _scratch(spark, "tokenizer")
    files.save_tokenizer(spark, bench_model(spark, sf), base, SEQ_LEN, BENCH_VOCAB)
    loaded, meta = files.load_tokenizer(spark, base)
    return bpe.vocab_frame(spark, loaded).withColumn("seq_len", F.lit(meta.seq_len))


def bpe_tokens(spark, sf):
    """P1 with the benchmark tokenizer, written once per session and scale."""
    key = (_app(spark), sf, "bpe")
    if key not in _TOKENS:
        p = P1.ShardParams(n_shards=N_SHARDS, file_size=FILE_SIZE, seq_len=SEQ_LEN)
        s = written(p1_sentences(spark, sf))
        out = P1.encode_sentences_bpe(s.drop("doc_id", "sent_idx", "pos"), bench_model(spark, sf), p, keep_raw=True)
        _TOKENS[key] = written(out.select("shard", "file_idx", "row", "example_id", "rel_path", "raw_ids", "ids"))
        drop_written(s)
    return _TOKENS[key]


@query("h5_bpe_ids", with_training(CTE_BPE_TOKENS, f"SELECT example_id, {sql_ids('raw_ids')} AS raw_ids FROM tokens"))
def h5_bpe_ids(spark, sf):
    """H5 + H6: the BPE ids of every sentence, by the dictionary of its words."""
    return bpe_tokens(spark, sf).select("example_id", ids_str("raw_ids").alias("raw_ids"))


@query("p1_bpe_token_shards", with_training(CTE_BPE_TOKENS, f"""
SELECT shard, file_idx, row, example_id, {sql_ids('ids')} AS ids FROM tokens"""))
def p1_bpe_token_shards(spark, sf):
    """P1 with the trained tokenizer (H5-H8), written as token files (B4) and scanned back (A4)."""
    base = _scratch(spark, "bpe-tokens")
    files.write_token_shards(bpe_tokens(spark, sf), base)
    t = files.read_token_shards(spark, base)
    return t.select("shard", "file_idx", "row", "example_id", ids_str("ids").alias("ids"))


@query("h9_decode_bpe", with_training(CTE_BPE_TOKENS, """
SELECT example_id, rtrim(replace(array_to_string(list_transform(list_filter(ids, lambda i: i >= 3),
       lambda i: pieces[i + 1]), ''), '</w>', ' ')) AS text FROM tokens, pieces"""))
def h9_decode_bpe(spark, sf):
    """H9 with a suffix: padded BPE ids back to text, ``</w>`` as a space."""
    to_pieces = encode.id_lookup(bpe.vocab_frame(spark, bench_model(spark, sf)))
    return bpe_tokens(spark, sf).select("example_id", encode.decode(F.col("ids"), to_pieces).alias("text"))


# =========================== L: streaming batch assembly ===================
import uuid  # noqa: E402

from lexforge.session import checkpoint_dir  # noqa: E402
from lexforge.sources import files  # noqa: E402
from lexforge.streaming import batches as streaming  # noqa: E402


def _scratch(spark, tag):
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


CTE_STREAM = CTE_TOKENS + [
    ("arrived", f"""SELECT *, CAST(row_number() OVER (ORDER BY shard >= {N_SHARDS // 2},
        'shard=' || CAST(shard AS VARCHAR) || '/file_idx=' || CAST(file_idx AS VARCHAR), row) - 1 AS BIGINT) AS pos
        FROM tokens"""),
    ("batches", f"""SELECT pos // {BATCH} AS batch_id, CAST(pos % {BATCH} AS INTEGER) AS batch_pos, example_id, ids
        FROM arrived WHERE pos // {BATCH} < (SELECT count(*) FROM arrived) // {BATCH}"""),
]


def stream_in_two_runs(spark, sf, transform=None):
    """P1 token files written to a folder in two halves; after each, a streaming
    run takes what is there and stops, the second one resuming the first."""
    base = _scratch(spark, "stream")
    tokens = p1_tokens(spark, sf)
    late = F.col("shard") >= N_SHARDS // 2
    for half, reset in ((tokens.where(~late), True), (tokens.where(late), False)):
        files.write_token_shards(half, f"{base}/tokens", reset=reset)
        streaming.run_available(streaming.token_stream(spark, f"{base}/tokens"), f"{base}/out",
                                f"{base}/_checkpoint", BATCH, transform)
    return streaming.finished(spark, f"{base}/out", BATCH)


@query("l1_stream_batches", with_ctes(CTE_STREAM, f"SELECT batch_id, batch_pos, example_id, {sql_ids('ids')} AS ids FROM batches"))
def l1_stream_batches(spark, sf):
    """L1, L3, L4: the P1 token files, arriving in two halves, assembled into
    512-row batches by a streaming query that stops and resumes in between."""
    return stream_in_two_runs(spark, sf).select("batch_id", "batch_pos", "example_id", ids_str("ids").alias("ids"))


@query("l2_stream_admission", with_ctes(CTE_TOKENS, f"""
SELECT CAST(count(*) // {BATCH} * {BATCH} AS BIGINT) AS n_rows, CAST(count(*) // {BATCH} * {BATCH} AS BIGINT) AS n_examples,
  CAST(count(*) // {BATCH} AS BIGINT) AS n_batches, true AS files_within_bound FROM tokens"""))
def l2_stream_admission(spark, sf):
    """L2: all token files through micro-batches of at most 3 files; what the
    full batches hold, and whether every micro-batch kept to the bound."""
    base = _scratch(spark, "admission")
    files.write_token_shards(p1_tokens(spark, sf), f"{base}/tokens")
    streaming.run_available(streaming.token_stream(spark, f"{base}/tokens", max_files_per_trigger=3),
                            f"{base}/out", f"{base}/_checkpoint", BATCH)
    rows = streaming.finished(spark, f"{base}/out", BATCH)
    per_micro = rows.select("micro", "rel_dir").distinct().groupBy("micro").agg(F.count(F.lit(1)).alias("files"))
    within = per_micro.agg(F.max("files") <= 3).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("example_id").alias("n_examples"),
                    F.countDistinct("batch_id").alias("n_batches")).withColumn("files_within_bound", within)


@query("l5_stream_masking", sql_mask(MASK_CONFIGS["m6_mask_batches"], VOCAB, [
    *CTE_STREAM[:-1], ("batches", CTE_STREAM[-1][1].replace("SELECT pos", "SELECT 0 AS epoch, pos", 1))]))
def l5_stream_masking(spark, sf):
    """Each micro-batch masked inside the stream, before it is written."""
    def mask(rows):
        return masking.mask_batches(rows.withColumn("epoch", F.lit(0)), MASK_CONFIGS["m6_mask_batches"])
    m = stream_in_two_runs(spark, sf, mask)
    return m.select("epoch", "batch_id", "batch_pos", "example_id",
                    ids_str("masked_ids").alias("masked_ids"),
                    F.array_join(F.transform("selected", lambda b: b.cast("int")), ",").alias("selected"),
                    ids_str("attention_mask").alias("attention_mask"))


# =========================== A / B / J2: sources and sinks (round trips) ===
DOCS_PER_FILE = 300


@query("a2_line_scan", f"""
SELECT shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS BIGINT) AS line_no,
       replace(text, chr(10), ' ') AS value
FROM (SELECT text, pos, {sql_contiguous_shard('pos', 'total', N_SHARDS)} AS shard FROM ({SQL_DOC_SHUFFLE}))""")
def a2_line_scan(spark, sf):
    """B2 + A2: documents written as one-line-per-document shard files, read
    back line by line with their file and dense line number."""
    base = _scratch(spark, "lines")
    d = sampling.assign_shards(shuffled_docs(spark, sf), "pos", N_SHARDS, total=doc_total(spark, sf))
    files.write_document_lines(d, base)
    lines = files.read_lines(spark, base)
    return lines.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"),
                        "line_no", "value")


@query("b3_sentence_files", f"""
SELECT CAST(doc_pos // {DOCS_PER_FILE} AS INTEGER) AS file_idx,
       CAST(row_number() OVER (PARTITION BY doc_pos // {DOCS_PER_FILE} ORDER BY doc_pos, i) - 1 AS BIGINT) AS line_no,
       replace(parts[i], chr(10), ' ') AS value
FROM (SELECT pos AS doc_pos, {SQL_SENT_PARTS} AS parts FROM ({SQL_DOC_SHUFFLE})) s,
     unnest(generate_series(1, len(s.parts))) AS t(i)
WHERE {SQL_NOT_BLANK}""")
def b3_sentence_files(spark, sf):
    """Sentences of the shuffled corpus written 300 documents per file
    (one sentence per line), read back line by line."""
    base = _scratch(spark, "sents")
    s = sentences.split_sentences(shuffled_docs(spark, sf).withColumnRenamed("pos", "doc_pos"))
    files.write_sentence_files(s, base, DOCS_PER_FILE)
    lines = files.read_lines(spark, base)
    return lines.select(F.regexp_extract("file", r"file_idx=(\d+)", 1).cast("int").alias("file_idx"),
                        "line_no", "value")


def _written_tokens(spark, sf):
    base = _scratch(spark, "tokens")
    files.write_token_shards(p1_tokens(spark, sf), base)
    return base


@query("a4_token_shard_scan", with_ctes(CTE_TOKENS, f"""
SELECT shard, file_idx, row, example_id, {sql_ids('ids')} AS ids FROM tokens"""))
def a4_token_shard_scan(spark, sf):
    """B4 + A4: token files written partitioned by shard/file and scanned back."""
    t = files.read_token_shards(spark, _written_tokens(spark, sf))
    return t.select("shard", "file_idx", "row", "example_id", ids_str("ids").alias("ids"))


@query("b1_output_policy", with_ctes(CTE_TOKENS, """
SELECT 'keep' AS policy, shard, file_idx, row, example_id FROM tokens WHERE shard <> 1 OR row < 10
UNION ALL SELECT 'reset' AS policy, shard, file_idx, row, example_id FROM tokens WHERE shard = 2"""))
def b1_output_policy(spark, sf):
    """B1: token files written again, some of them: without reset their folders are
    replaced and all others kept, with reset nothing else is left."""
    t = p1_tokens(spark, sf)
    out = []
    for policy, again in (("keep", t.where("shard = 1 AND row < 10")), ("reset", t.where("shard = 2"))):
        base = _scratch(spark, policy)
        files.write_token_shards(t, base)
        files.write_token_shards(again, base, reset=policy == "reset")
        out.append(files.read_token_shards(spark, base)
                   .select(F.lit(policy).alias("policy"), "shard", "file_idx", "row", "example_id"))
    return out[0].unionByName(out[1])


@query("a3_file_listing", with_ctes(CTE_TOKENS, """
SELECT DISTINCT shard, file_idx FROM tokens"""))
def a3_file_listing(spark, sf):
    """A3: recursive listing of the written token files (contents not read);
    one parquet file per (shard, file) folder."""
    lst = files.list_files(spark, _written_tokens(spark, sf), ".parquet")
    return lst.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard"),
                      F.regexp_extract("path", r"file_idx=(\d+)", 1).cast("int").alias("file_idx"))


@query("a6_coverage_reload", f"""
SELECT word, n, rank FROM ({SQL_RANKED}) WHERE n_before * 1000000 < 900000 * total""")
def a6_coverage_reload(spark, sf):
    """B5 + A6: the 90% coverage list written as JSON and reloaded with a schema."""
    base = _scratch(spark, "coverage")
    files.write_word_counts(vocab.coverage_cut(vocab.word_counts(docs(spark, sf))), base)
    return files.read_word_counts(spark, base)


@query("j2_run_log_scan", with_ctes(CTE_RUNLOG, f"""
SELECT run, step, epoch, round(loss, 6) AS loss,
       round(pow(512.0, -0.5) * least(pow(step + 1, -0.5), (step + 1) * pow(10000.0, -1.5)), 12) AS lr,
       CAST(json_extract(e.props, '$.k') AS DOUBLE) AS k_stat
FROM rl2 JOIN events e USING (event_id)"""))
def j2_run_log_scan(spark, sf):
    """Run-log records (11 fields, two map columns) written as JSON and
    read back with the explicit schema."""
    base = _scratch(spark, "runlog")
    ev = read_table(spark, sf, "events").select("event_id", "props")
    r = run_log(spark, sf).join(ev, "event_id")
    recs = r.select("run", "epoch", "step", "examples", "loss",
                    runlog.learning_rate("step").alias("lr"), F.col("ts").cast("timestamp").alias("ts"),
                    F.from_json("props", "map<string,double>").alias("weight_stats"),
                    F.map_from_arrays(F.array(F.lit("loss")), F.array(F.col("loss"))).alias("grad_norms"),
                    "is_checkpoint", "event_id")
    recs.write.mode("overwrite").json(base)
    back = spark.read.schema(runlog.RUN_LOG_SCHEMA).json(base)
    return back.select("run", "step", "epoch", F.round("loss", 6).alias("loss"), F.round("lr", 12).alias("lr"),
                       F.col("weight_stats")["k"].alias("k_stat"))


@query("b7_tokenizer_artifact")
def b7_tokenizer_artifact(spark, sf):
    """B6 + B7 + A5: the trained tokenizer saved (vocab, merges in blocks of
    100 with the tail, metadata) and loaded back; returns the loaded vocab."""
    base = _scratch(spark, "tokenizer")
    model = library_model(spark, sf)
    files.save_tokenizer(spark, model, base, SEQ_LEN, H1_VOCAB)
    files.write_merges(spark, model, f"{base}/merge_blocks", every=100)
    loaded, meta = files.load_tokenizer(spark, base)
    return bpe.vocab_frame(spark, loaded).withColumn("seq_len", F.lit(meta.seq_len))
