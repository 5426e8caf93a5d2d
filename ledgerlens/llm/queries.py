"""The registered queries of the subpackage, one per operator, and their SQL statements."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (base, bpe, html_text, importance, katz, maxscore, ngram_join, packing, pieces, quality, sharding, suffix_dedup, vptree,
               whitening)

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, each with the mixture of sources; counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = base.read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.interleave(docs, "doc_id", "source", 16, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


SQL["op4_interleaved_shards"] = r"""
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
base AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         coalesce('=' || source, 'null') AS s
  FROM documents, crc
), ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, size, text_crc32) - 1) + 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM base
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM ranked
), cut AS (SELECT *, (p * 16) // n AS sh FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, sh::INT AS shard, (p - (sh * n + 15) // 16)::BIGINT AS slot,
       NULL::INT AS grown_shard, source
FROM cut
"""


@query
def op3_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products for every fiftieth vector, against all rows."""
    rows = base.read(spark, sf_dir, "embeddings")
    return maxscore.top_scores(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


SQL["op3_maxscore_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

VP_FACTOR = 0.18    # recall 0.96 to 0.99 on the given vectors, see tests/llm/test_vectors.py


@query
def op5_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five near vectors by cosine for every fiftieth vector, against all rows; recall is measured in the tests."""
    rows = base.read(spark, sf_dir, "embeddings")
    return vptree.neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0), 5, VP_FACTOR)


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; links from 75 hundredths of shared five-word shingles."""
    return ngram_join.near_duplicates(base.read(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of rows that each document links with."""
    return ngram_join.link_counts(base.read(spark, sf_dir, "documents"))


_SHINGLES = """
words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
)"""
SQL["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE {_SHINGLES}, sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(y))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached ON x = d.doc_id GROUP BY d.doc_id, n
"""


SQL["op1_ngram_jaccard_links"] = SQL["op1_ngram_jaccard_join"].replace(
    "SELECT d.doc_id, ", "SELECT d.doc_id, (SELECT count(*) FROM links l WHERE l.x = d.doc_id)::BIGINT AS n_links, ")


KEEP = 0.7      # a document is kept from this score on


@query
def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, base.read(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


@query
def op10_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    pages = base.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_bpe_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, *tokenizer_files()[1:])


def tokenizer_files() -> tuple[str, str, str]:
    """The vocabulary as a tokenizer and as ranks, and the pattern of its words."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op2_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.packed(base.read(spark, sf_dir, "documents"), *tokenizer_files())


@query
def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and Katz score of every document; a tenth of the documents is held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return katz.scores(docs, order=2)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once the 50-byte strings of earlier documents are taken out."""
    return suffix_dedup.summary(suffix_dedup.repeated_ranges(base.read(spark, sf_dir, "documents").select("doc_id", "text")))


SQL["op7_suffix_dedup"] = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, greatest(n - 49, 0))) AS i FROM raw)),
firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE first_id < doc_id),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
  UNION ALL SELECT doc_id, n + 1, n + 1, coalesce((SELECT max(b) FROM spans s WHERE s.doc_id = raw.doc_id), 0) FROM raw),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (least(a, n) - since)), '' ORDER BY a) AS left_over
         FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a) AS bytes, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
       sha256(unhex(left_over)) AS kept_sha256
FROM raw JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


def _digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op11_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encoded(base.read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = ids.withColumns({"n_tokens": F.size("ids").cast("long"), "list": F.array_join(F.col("ids").cast("array<string>"), ",")})
    ids = ids.select("doc_id", "n_tokens", _digest("list").alias("ids_sha256"), "ids")
    return pieces.decoded(ids, path).withColumn("decoded_sha256", _digest("text")).drop("text")


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a quarter towards the texts of ``benchmark``."""
    out = importance.resampled(base.read(spark, sf_dir, "documents").select("doc_id", "text"), base.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op12_importance_resampling"] = r"""
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
texts AS (
  SELECT 0 AS kind, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT kind, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (SELECT kind, r, f, count(*) AS c FROM grams GROUP BY ALL),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS b FROM (SELECT DISTINCT f FROM counted), crc
), sums AS (SELECT kind, b, sum(c) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM sums),
gains AS (
  SELECT b, floor(1000 * ln((coalesce(y.n, 0) + 1)::DOUBLE * (s + 10000)::DOUBLE / ((x.n + 1)::DOUBLE * (t + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT * FROM sums WHERE kind = 0) x LEFT JOIN (SELECT * FROM sums WHERE kind = 1) y USING (b), totals
), means AS (
  SELECT r, sum(c)::BIGINT AS n, floor(sum(c * g)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (b) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN means USING (r) WHERE kind = 0
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM drawn WHERE rank <= k) USING (doc_id)
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every usable vector."""
    return whitening.whitened(base.read(spark, sf_dir, "embeddings"))
