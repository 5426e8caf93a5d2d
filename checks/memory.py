"""Case memory, nearest neighbours and text retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import features as FT
from ledgerlens.operators import memory as M
from ledgerlens.operators import similarity as N
from ledgerlens.operators.search import TextIndex
from ledgerlens.session import stored
from ledgerlens.sources.testbed import Bank, table

from .features import KEYED
from .prelude import DAY, cases, full
from .registry import query

EP = """ep AS (SELECT m.case_id, k.* EXCLUDE (k) FROM case_txns m JOIN keyed k USING (TransactionID))"""
FEATS = EP, f"""
  span AS (SELECT case_id, customer_id, min(us) AS first_us FROM ep GROUP BY ALL)""", f"""
  past AS (SELECT s.case_id, h.* FROM span s JOIN keyed h ON h.customer_id = s.customer_id AND h.us >= first_us - {90 * DAY} AND h.us < first_us)""", """
  feats AS (SELECT case_id, count(*)::DOUBLE AS n, ln(1 + count(*)) AS log_n, avg((channel = 'online')::INT) AS frac_online,
    avg((ProductCD = 'W')::INT) AS frac_w, (bool_or(channel = 'online') AND bool_or(channel <> 'online'))::INT AS mixed_channel,
    avg(coalesce(id_15 = 'New', false)::INT) AS frac_new_dev, bool_or(coalesce(id_15 = 'New', false))::INT AS any_new_dev,
    avg(coalesce(id_15 = 'Found', false)::INT) AS frac_found_dev, bool_or(id_23 IS NOT NULL)::INT AS any_proxy,
    avg((device_profile_id IS NOT NULL)::INT) AS frac_has_device, count(*) FILTER (TransactionAmt < 5 AND channel = 'online') AS n_small_online,
    avg((TransactionAmt < 5 AND channel = 'online')::INT) AS frac_small, max(TransactionAmt) AS max_amt, avg(TransactionAmt) AS mean_amt,
    count(DISTINCT addr1) AS n_regions,
    avg((addr1 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM past p WHERE p.case_id = ep.case_id AND p.addr1 = ep.addr1))::INT) AS frac_region_unseen,
    avg((addr1 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM past p JOIN ep e2 ON e2.case_id = p.case_id AND e2.uid = p.uid
      WHERE p.case_id = ep.case_id AND p.addr1 = ep.addr1))::INT) AS frac_uid_region_unseen,
    avg((device_profile_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM past p WHERE p.case_id = ep.case_id
      AND p.device_profile_id = ep.device_profile_id))::INT) AS frac_dev_unseen,
    (max(us) - min(us)) / 3600e6 AS span_h, count(DISTINCT ProductCD) AS n_products, avg((M4 = 'M2')::INT) AS frac_m4_m2,
    avg((M6 = 'F')::INT) AS frac_m6_f, count(DISTINCT P_emaildomain) AS n_emails,
    (SELECT count(*) FROM past p WHERE p.case_id = ep.case_id) AS hist_n, max(p_txn) AS p_flag
    FROM ep GROUP BY case_id)"""
KEYED_ONLY = KEYED[1:2]


def index_of(bank):
    if not hasattr(bank, "_index"):
        bank._keyed = FT.with_cardholder_keys(bank.ledger)
        bank._index = M.case_index(bank.closed, bank.case_txns, bank._keyed)
    return bank._index


@query("episode_features", cases("SELECT case_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in M.FEATURES) + " FROM feats",
                                 *KEYED_ONLY, *FEATS))
def episode_features(spark, sf):
    return index_of(Bank(spark, sf)).select("case_id", *[F.round(f, 6).alias(f) for f in M.FEATURES])


@query("case_index", cases("SELECT case_id, outcome, pattern, closed_us, card_id, customer_id, round(p_flag, 6) AS p_flag FROM feats "
                           "JOIN closed USING (case_id)", *KEYED_ONLY, *FEATS))
def case_index(spark, sf):
    return index_of(Bank(spark, sf)).select("case_id", "outcome", "pattern", "closed_us", "card_id", "customer_id",
                                            F.round("p_flag", 6).alias("p_flag"))


@query("case_keys", cases("""SELECT DISTINCT case_id, 'uid' AS kind, uid AS value FROM ep UNION ALL
  SELECT DISTINCT case_id, 'device', device_profile_id FROM ep WHERE device_profile_id IS NOT NULL""", *KEYED_ONLY, EP))
def case_keys(spark, sf):
    b = Bank(spark, sf)
    return M.case_keys(M.case_episodes(b.case_txns, FT.with_cardholder_keys(b.ledger)))


Z = ["vecs AS (SELECT case_id, outcome, closed_us, opened_us, [" + ", ".join(
    f"greatest(-5, least(5, ({f} - (SELECT avg({f}) FROM feats)) / (SELECT coalesce(nullif(stddev_samp({f}), 0), 1) FROM feats)))"
    for f in M.FEATURES) + "] AS v FROM feats JOIN closed USING (case_id))"]


@query("case_vectors", cases("SELECT case_id, " + ", ".join(f"round(v[{i + 1}], 6) AS z{i}" for i in range(24)) + " FROM vecs",
                             *KEYED_ONLY, *FEATS, *Z))
def case_vectors(spark, sf):
    index = stored(index_of(Bank(spark, sf)))
    z = M.standardise(index, M.moments(index))
    return z.select("case_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"z{i}") for i in range(24)])


def _knn_sql(k, where):
    return cases(f"""SELECT query_id, point_id, round(d, 6) AS distance, rank FROM (
      SELECT a.case_id AS query_id, b.case_id AS point_id, list_distance(a.v, b.v) AS d,
        row_number() OVER (PARTITION BY a.case_id ORDER BY round(list_distance(a.v, b.v), 9), b.case_id) AS rank
      FROM vecs a JOIN vecs b ON b.closed_us < a.opened_us {where}) WHERE rank <= {k}""", *KEYED_ONLY, *FEATS, *Z)


def _knn(spark, sf, k, outcome=None):
    index = stored(index_of(Bank(spark, sf)))
    z = M.standardise(index, M.moments(index))
    q = z.select(F.col("case_id").alias("query_id"), "v", F.col("opened_us").alias("as_of"))
    p = z if outcome is None else z.filter(F.col("outcome") == outcome)
    r = N.nearest(q, p.select(F.col("case_id").alias("point_id"), "v", F.col("closed_us").alias("since")), k)
    return r.select("query_id", "point_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("case_knn", _knn_sql(5, ""))
def case_knn(spark, sf):
    """Every closed case as a query against the cases closed before it was opened."""
    return _knn(spark, sf, 5)


@query("case_knn_cleared", _knn_sql(3, "AND b.outcome = 'cleared'"))
def case_knn_cleared(spark, sf):
    return _knn(spark, sf, 3, "cleared")


@query("embedding_knn", """
  WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
  SELECT query_id, point_id, round(d, 5) AS distance, rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS point_id, list_distance(a.v, b.v) AS d,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
    FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 3""")
def embedding_knn(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.select(F.col("vec_id").alias("query_id"), "v", F.lit(1).alias("as_of"))
    p = e.select(F.col("vec_id").alias("point_id"), "v", F.lit(0).alias("since"))
    p = p.withColumn("point_id", F.col("point_id").cast("string"))
    r = N.nearest(q.withColumn("query_id", F.col("query_id").cast("string")), p, 3, exclude_self=True)
    return r.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("point_id").cast("bigint").alias("point_id"),
                    F.round("distance", 5).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("approximate_neighbours")
def approximate_neighbours(spark, sf):
    """Hash-based neighbour pairs among the embeddings; may miss pairs, so only its rows are checked."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    r = N.approximate_pairs(e.select(F.col("vec_id").alias("query_id"), "v"), e.select(F.col("vec_id").alias("point_id"), "v"), 1.2)
    return r.filter(F.col("query_id") < F.col("point_id"))


@query("graph_links", full("""
  SELECT case_id, closed_case, outcome, ['same cardholder (uid)', 'same card', 'same device profile', 'same customer'][first] AS link,
    [0, 2, 1, 3][first] AS link_rank FROM (
    SELECT a.case_id, c.case_id AS closed_case, c.outcome,
      CASE WHEN EXISTS (SELECT 1 FROM ep WHERE ep.case_id = c.case_id AND ep.uid = f.uid) THEN 1 WHEN c.card_id = f.card_id THEN 2
        WHEN EXISTS (SELECT 1 FROM ep WHERE ep.case_id = c.case_id AND ep.device_profile_id = f.device_profile_id) THEN 3
        WHEN c.customer_id = a.customer_id THEN 4 END AS first
    FROM alerts a JOIN keyed f ON f.TransactionID = a.flagged_txn_id JOIN closed c ON c.closed_us < a.opened_us) WHERE first IS NOT NULL""",
  *KEYED_ONLY, EP))
def graph_links(spark, sf):
    b = Bank(spark, sf)
    keyed = FT.with_cardholder_keys(b.ledger)
    f = b.alerts.select("case_id", "flagged_txn_id", F.col("opened_us").alias("as_of")).join(
        keyed, F.col("flagged_txn_id") == F.col("TransactionID"))
    keys = M.case_keys(M.case_episodes(b.case_txns, keyed))
    r = M.graph_links(f.select("case_id", "customer_id", "as_of"), f.select("case_id", "uid"), f.select("case_id", "card_id"),
                      f.select("case_id", "device_profile_id").filter(F.col("device_profile_id").isNotNull()), b.closed, keys)
    return r.select("case_id", "closed_case", "outcome", "link", "link_rank")


# ---- text ------------------------------------------------------------------------------------------

WORDS = "list_filter(regexp_extract_all(lower({t}), '[a-z][a-z0-9_]{{2,}}'), lambda w: NOT list_contains(" + str(X.STOP) + ", w))"


def counts_sql(name, src, text):
    return f"""{name}_w AS (SELECT id, {WORDS.format(t=text)} AS w FROM {src})""", f"""
  {name} AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS token
    FROM {name}_w) GROUP BY ALL)"""


def vectors_sql(name, counts, idf):
    return f"""{name}_d AS (SELECT c.id, (('0x' || substr(md5(token), 1, 2))::INT % 128) AS dim,
      sum(tf / mx * coalesce(idf, 1.0) * CASE WHEN ('0x' || substr(md5(token), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS w
    FROM {counts} c JOIN (SELECT id, max(tf) AS mx FROM {counts} GROUP BY 1) USING (id) LEFT JOIN {idf} USING (token) GROUP BY ALL)""", f"""
  {name} AS (SELECT id, dim, w / coalesce(nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0), 1) AS w FROM {name}_d)"""


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)", *counts_sql("dc", "docs", "text"), \
    """idf AS (SELECT token, count(*) AS df, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf FROM dc GROUP BY 1)"""


def with_(sql, *ctes):
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + sql


@query("document_tokens", with_("SELECT id AS doc_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_distinct, max(tf) AS max_tf FROM dc GROUP BY 1", *DOCS))
def document_tokens(spark, sf):
    c = X.token_counts(table(spark, sf, "documents"))
    return c.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"), F.max("max_tf").alias("max_tf"))


@query("document_idf", with_("SELECT token, df, round(idf, 6) AS idf FROM idf", *DOCS))
def document_idf(spark, sf):
    d = table(spark, sf, "documents")
    return X.fit_idf(X.token_counts(d), d.count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query("document_vectors", with_("SELECT id AS doc_id, dim, round(w, 6) AS w FROM dv WHERE abs(w) > 1e-9", *DOCS, *vectors_sql("dv", "dc", "idf")))
def document_vectors(spark, sf):
    d = table(spark, sf, "documents")
    c = stored(X.token_counts(d))
    return X.embed(c, X.fit_idf(c, d.count())).filter(F.abs("w") > 1e-9).withColumn("w", F.round("w", 6))


def rounded(found):
    return found.select("query_id", "point_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def search_sql(k):
    return f"""SELECT query_id, point_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY round(score, 10) DESC, point_id) AS rank FROM (SELECT q.id AS query_id, d.id AS point_id, sum(q.w * d.w) AS score
      FROM qv q JOIN dv d USING (dim) GROUP BY ALL) WHERE score >= 0.05) WHERE rank <= {k}"""


@query("text_search", with_(search_sql(4).replace("q.id AS query_id, d.id AS point_id", "q.id::VARCHAR AS query_id, d.id::VARCHAR AS point_id"),
                            *DOCS, *vectors_sql("dv", "dc", "idf"), "qs AS (SELECT item_id AS id, text FROM benchmark)",
                            *counts_sql("qc", "qs", "text"), *vectors_sql("qv", "qc", "idf")))
def text_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return rounded(TextIndex(d).search(q, 4))


CASE_TEXT = """'pattern ' || pattern || ' outcome ' || outcome || ' exposure_band ' || CASE WHEN exposure_usd >= 500 THEN 'large'
  WHEN exposure_usd >= 100 THEN 'medium' ELSE 'small' END || ' txns ' || n_txns || ' ' || analyst_notes || ' ' || actions_taken"""


def case_texts(bank):
    c = F.col
    return bank.closed.select(c("case_id").alias("id"), X.case_text(c("pattern"), c("outcome"), c("exposure_usd"), c("n_txns"),
                                                                    c("analyst_notes"), c("actions_taken")).alias("text"))


@query("case_texts", cases(f"SELECT case_id AS id, {CASE_TEXT} AS text FROM closed"))
def case_texts_query(spark, sf):
    return case_texts(Bank(spark, sf))


ALERT_TEXT = """'trigger ' || trigger_text || ' pattern card_testing exposure_band ' || CASE WHEN TransactionAmt >= 500 THEN 'large'
  WHEN TransactionAmt >= 100 THEN 'medium' ELSE 'small' END || CASE WHEN device_profile_id IS NOT NULL THEN ' device shared by cards new_device' ELSE '' END
  || ' several online purchases just under limit'"""


@query("investigation_texts", full(f"SELECT case_id AS id, {ALERT_TEXT} AS text FROM alerts JOIN ledger ON TransactionID = flagged_txn_id"))
def investigation_texts(spark, sf):
    b = Bank(spark, sf)
    c = F.col
    f = b.alerts.select("case_id", "trigger_text", "flagged_txn_id").join(b.ledger, c("flagged_txn_id") == c("TransactionID"))
    return f.select(c("case_id").alias("id"), X.investigation_text(
        c("trigger_text"), F.lit("card_testing"), c("TransactionAmt"), c("device_profile_id").isNotNull(),
        F.array(F.lit("several online purchases just under limit"))).alias("text"))


@query("case_text_scores", full("""
  SELECT query_id, max(score) AS best, count(*) AS n FROM (SELECT q.id AS query_id, d.id AS point_id, round(sum(q.w * d.w), 5) AS score
    FROM qv q JOIN dv d USING (dim) GROUP BY ALL) WHERE score >= 0.05 GROUP BY 1""",
  f"docs AS (SELECT case_id AS id, {CASE_TEXT} AS text FROM closed)", *counts_sql("dc", "docs", "text"), DOCS[3],
  *vectors_sql("dv", "dc", "idf"), f"qs AS (SELECT case_id AS id, {ALERT_TEXT} AS text FROM alerts JOIN ledger ON TransactionID = flagged_txn_id)",
  *counts_sql("qc", "qs", "text"), *vectors_sql("qv", "qc", "idf")).replace("SELECT query_id, max(score) AS best, count(*) AS n",
                                                                         "SELECT query_id, max(score) AS best"))
def case_text_scores(spark, sf):
    """Best matching closed case per alert; the templated notes tie, so the score is compared, not the id."""
    found = TextIndex(case_texts(Bank(spark, sf))).search(investigation_texts(spark, sf), 1)
    return rounded(found).select("query_id", F.col("score").alias("best"))
