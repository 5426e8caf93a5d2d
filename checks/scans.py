"""Sources, sinks, projections and scalar expressions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.session import new_folder
from ledgerlens.sources import ledger as L
from ledgerlens.sources import schema as S
from ledgerlens.sources import testbed as T

from .prelude import cases, led, led_alerts
from .registry import query

BASIC = "TransactionID, us, TransactionAmt, ProductCD, channel, customer_id, card_id, addr1, device_profile_id"


@query("ledger_build", led(f"SELECT {BASIC}, TransactionDT, risk_score, addr2, P_emaildomain, R_emaildomain, D1, "
                           "M4, M6, id_15, id_23, has_device_record FROM ledger"))
def ledger_build(spark, sf):
    return T.ledger(spark, sf).select(*BASIC.split(", "), "TransactionDT", "risk_score", "addr2", "P_emaildomain",
                                      "R_emaildomain", "D1", "M4", "M6", "id_15", "id_23", "has_device_record")


@query("ledger_csv_roundtrip", led("SELECT TransactionID, TransactionAmt, card_id, device_profile_id, has_device_record, "
                                   "addr1 FROM ledger"))
def ledger_csv_roundtrip(spark, sf):
    """Write the raw layout as CSV and rebuild the ledger from it with declared schemas."""
    raw = T.raw_ledger(spark, sf).withColumn("ts", C.from_micros(F.col("us")))
    out = new_folder(spark)
    cols = [f.name for f in S.TRANSACTIONS.fields if f.name in raw.columns]
    raw.select(*cols).write.option("header", True).csv(f"{out}/transactions.csv")
    ids = [f.name for f in S.IDENTITY.fields if f.name in raw.columns]
    (raw.filter(F.coalesce(*S.DEVICE_PARTS).isNotNull()).select(*ids)
     .write.option("header", True).csv(f"{out}/identity.csv"))
    return L.read_raw_ledger(spark, out).select("TransactionID", "TransactionAmt", "card_id", "device_profile_id",
                                                "has_device_record", "addr1")


@query("ledger_prepared_csv", led("SELECT TransactionID, TransactionAmt, card_id, device_profile_id, id_15, M4, C1 FROM ledger"))
def ledger_prepared_csv(spark, sf):
    led_ = T.ledger(spark, sf).withColumn("ts", C.from_micros(F.col("us")))
    out = new_folder(spark)
    core = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "customer_id", "ts", "channel",
            "risk_score", "addr1", "addr2", "dist1", "P_emaildomain", "R_emaildomain", "card_id", "device_profile_id"]
    led_.select(*core).write.option("header", True).csv(f"{out}/transactions_core.csv")
    led_.select("TransactionID", "device_profile_id", "id_15", "id_23", "DeviceType", "has_device_record").write.option(
        "header", True).csv(f"{out}/identity_signals.csv")
    led_.select("TransactionID", "C1", "C2", "D1", "M4", "M6").write.option("header", True).csv(
        f"{out}/transactions_signals.csv")
    return L.read_prepared_ledger(spark, out).select("TransactionID", "TransactionAmt", "card_id", "device_profile_id",
                                                     "id_15", "M4", "C1")


@query("ledger_parquet_by_day", led("SELECT CAST(make_timestamp(us) AS DATE)::VARCHAR AS day, count(*) AS n, "
                                    "round(sum(TransactionAmt), 4) AS total FROM ledger GROUP BY 1"))
def ledger_parquet_by_day(spark, sf):
    out = new_folder(spark)
    L.write_ledger(T.ledger(spark, sf).withColumn("day", F.to_date(C.from_micros(F.col("us")))), out)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("TransactionAmt"), 4).alias("total"))


@query("ledger_store_build", led("SELECT TransactionID, card_id, TransactionAmt FROM ledger"))
def ledger_store_build(spark, sf):
    """Source choice and idempotence: the second build returns the stored table untouched."""
    raw = T.raw_ledger(spark, sf).withColumn("ts", C.from_micros(F.col("us")))
    src, out = new_folder(spark), new_folder(spark) + "/store"
    raw.select(*[f.name for f in S.TRANSACTIONS.fields if f.name in raw.columns]).write.option("header", True).csv(
        f"{src}/transactions.csv")
    raw.select("TransactionID", "id_15", "id_23", *S.DEVICE_PARTS).write.option("header", True).csv(f"{src}/identity.csv")
    L.build_store(spark, src, out)
    return L.build_store(spark, src + "/absent", out).select("TransactionID", "card_id", "TransactionAmt")


@query("closed_cases_csv", cases("""
  SELECT case_id, customer_id, card_id, opened_us, closed_us, outcome, pattern, n_txns, exposure_usd,
    array_to_string(connected_card_ids, '|') AS connected, n_members FROM closed
  JOIN (SELECT case_id, count(*) AS n_members FROM case_txns GROUP BY 1) USING (case_id)"""))
def closed_cases_csv(spark, sf):
    bank = T.Bank(spark, sf)
    ids = bank.case_txns.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("TransactionID")), "|").alias("txn_ids"))
    out = new_folder(spark) + "/closed.csv"
    (bank.closed.join(ids, "case_id").withColumns({
        "opened_at": C.from_micros(F.col("opened_us")), "closed_at": C.from_micros(F.col("closed_us")),
        "connected_card_ids": F.array_join("connected_card_ids", "|")})
     .select(*[f.name for f in S.CLOSED_CASES.fields]).write.option("header", True)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(out))
    head, members = L.read_closed_cases(spark, out)
    n = members.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_members"))
    return head.join(n, "case_id").select("case_id", "customer_id", "card_id", "opened_us", "closed_us", "outcome", "pattern",
                                          F.col("n_txns").cast("bigint").alias("n_txns"), "exposure_usd",
                                          F.array_join("connected_card_ids", "|").alias("connected"), "n_members")


@query("alerts_csv", led_alerts("SELECT case_id, customer_id, card_id, flagged_txn_id, opened_us, trigger_type, "
                                "trigger_text, risk_score FROM alerts"))
def alerts_csv(spark, sf):
    out = new_folder(spark) + "/alerts.csv"
    a = T.Bank(spark, sf).alerts.withColumn("opened_at", C.from_micros(F.col("opened_us")))
    a.select(*[f.name for f in S.ALERTS.fields]).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(out)
    return L.read_alerts(spark, out).drop("opened_at")


@query("ledger_row_cap", led("SELECT TransactionID, us FROM ledger ORDER BY us, TransactionID LIMIT 500"))
def ledger_row_cap(spark, sf):
    return L.row_cap(T.ledger(spark, sf), 500).select("TransactionID", "us")


@query("case_memory_upsert", led_alerts("""
  SELECT case_id, card_id, CASE WHEN risk_score >= 0.1 THEN 'fraud' ELSE 'uncertain' END AS verdict,
    opened_us + 1 AS written_us FROM alerts"""))
def case_memory_upsert(spark, sf):
    """Append every record twice; the later write of each case wins."""
    a = T.Bank(spark, sf).alerts.select("case_id", "card_id", "risk_score", "opened_us")
    out = new_folder(spark)
    L.append_case_memory(a.select("case_id", "card_id", F.lit("uncertain").alias("verdict"),
                                  F.col("opened_us").alias("written_us")), out)
    L.append_case_memory(a.select("case_id", "card_id", F.when(F.col("risk_score") >= 0.1, "fraud").otherwise("uncertain")
                                  .alias("verdict"), (F.col("opened_us") + 1).alias("written_us")), out)
    return L.latest_case_memory(spark.read.parquet(out))


@query("card_numbering_by_first_use", """
  WITH parts AS (SELECT CAST(event_id AS VARCHAR) AS TransactionID, epoch_us(ts) AS us, user_id,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
  firsts AS (SELECT user_id, k % 2 AS card2, k % 5 = 0 AS debit, min(us) AS first_us FROM parts GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_us) AS n FROM firsts)
  SELECT TransactionID, 'C' || lpad(CAST(user_id AS VARCHAR), greatest(5, length(CAST(user_id AS VARCHAR)))::INT, '0') || '-K' || n AS card_id
  FROM parts JOIN numbered USING (user_id) WHERE parts.k % 2 = card2 AND (parts.k % 5 = 0) = debit""")
def card_numbering_by_first_use(spark, sf):
    return L.number_cards_by_first_use(T.raw_ledger(spark, sf), ["card2", "card6"]).select("TransactionID", "card_id")


@query("device_columns", led("""
  SELECT TransactionID, 'D' || upper(substr(md5(device_profile_id), 1, 6)) AS device_id,
    replace(coalesce(device_profile_id, ''), '|', ' | ') AS label,
    coalesce(split_part(device_profile_id, '|', 1) NOT IN ('UNK', 'Windows', 'MacOS', 'iOS Device', 'Trident/7.0')
      AND split_part(device_profile_id, '|', 2) <> 'UNK' AND split_part(device_profile_id, '|', 4) <> 'UNK', false) AS specific,
    device_profile_id IS NOT NULL AND device_profile_id NOT LIKE '%UNK%' AS complete
  FROM ledger"""))
def device_columns(spark, sf):
    d = F.col("device_profile_id")
    return T.ledger(spark, sf).select(
        "TransactionID", C.device_digest(d).alias("device_id"), C.device_label(d).alias("label"),
        C.is_specific_device(d).alias("specific"), (d.isNotNull() & ~F.coalesce(d, F.lit("")).contains("UNK")).alias("complete"))


@query("probability_columns", led("""
  SELECT TransactionID, round(z, 6) AS z,
    round(least(greatest(1 / (1 + exp(-(z + ln(10.0)))), 0.02), 0.98), 6) AS up,
    round(least(greatest(1 / (1 + exp(-(z - ln(0.905 / 0.095)))), 0.02), 0.98), 6) AS shifted
  FROM p""", """p AS (SELECT TransactionID, ln(q / (1 - q)) AS z FROM
    (SELECT TransactionID, least(greatest(p_txn, 1e-6), 1 - 1e-6) AS q FROM ledger))"""))
def probability_columns(spark, sf):
    p = F.col("p_txn")
    return T.ledger(spark, sf).select(
        "TransactionID", F.round(C.logit(p), 6).alias("z"), F.round(C.bayes(p, F.lit(10.0)), 6).alias("up"),
        F.round(C.prior_shift(p), 6).alias("shifted"))


@query("text_columns", led("""
  SELECT customer_id, '$' || format('{:,.2f}', sum(TransactionAmt)) AS money,
    CASE WHEN sum(TransactionAmt) >= 500 THEN 'large' WHEN sum(TransactionAmt) >= 100 THEN 'medium' ELSE 'small' END AS band,
    'between ' || strftime(make_timestamp(min(us)), '%Y-%m-%d') || ' and ' || strftime(make_timestamp(max(us)), '%Y-%m-%d') AS span,
    count(*) FILTER (channel = 'online') || ' online and ' || count(*) FILTER (channel <> 'online') || ' in-person' AS mix,
    'billing region ' || string_agg(DISTINCT addr1, ', ' ORDER BY addr1) AS regions
  FROM ledger GROUP BY customer_id"""))
def text_columns(spark, sf):
    g = T.ledger(spark, sf).groupBy("customer_id").agg(
        F.sum("TransactionAmt").alias("total"), F.min("us").alias("a"), F.max("us").alias("b"),
        F.count_if(F.col("channel") == "online").alias("on"), F.count_if(F.col("channel") != "online").alias("off"),
        F.array_sort(F.collect_set("addr1")).alias("regs"))
    return g.select("customer_id", C.money(F.col("total")).alias("money"), C.exposure_band(F.col("total")).alias("band"),
                    C.span_text(F.col("a"), F.col("b")).alias("span"), C.channel_mix(F.col("on"), F.col("off")).alias("mix"),
                    C.region_text(F.col("regs")).alias("regions"))


@query("coercion_columns", led("""
  SELECT TransactionID, coalesce(TRY_CAST(addr1 AS DOUBLE), 0.0) AS addr_num,
    CASE WHEN coalesce(TRY_CAST(addr1 AS DOUBLE), 0) <> 0 THEN CAST(CAST(addr1 AS BIGINT) AS VARCHAR) ELSE 'UNKNOWN' END AS region_id,
    round(ln(1 + TransactionAmt), 6) AS log_amount, coalesce(P_emaildomain, 'NA') AS email,
    hour(make_timestamp(us)) AS hour, strftime(make_timestamp(us), '%Y-%m-%d %H:%M') AS at
  FROM ledger"""))
def coercion_columns(spark, sf):
    ts = C.from_micros(F.col("us"))
    return T.ledger(spark, sf).select(
        "TransactionID", C.safe_double(F.col("addr1")).alias("addr_num"), C.region_id(F.col("addr1")).alias("region_id"),
        F.round(F.log1p("TransactionAmt"), 6).alias("log_amount"), F.coalesce("P_emaildomain", F.lit("NA")).alias("email"),
        F.hour(ts).cast("bigint").alias("hour"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("at"))


@query("ledger_key_checks", cases("""
  SELECT count(*) AS n_cases, count(*) FILTER (hit) AS n_match, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate,
    0 AS alert_mismatches
  FROM (SELECT c.case_id, bool_or(l.card_id = c.card_id) AS hit FROM closed c JOIN case_txns m USING (case_id)
        JOIN ledger l ON l.TransactionID = m.TransactionID GROUP BY 1)"""))
def ledger_key_checks(spark, sf):
    bank = T.Bank(spark, sf)
    bad = L.alert_card_mismatches(bank.ledger, bank.alerts).agg(F.count(F.lit(1)).alias("alert_mismatches"))
    one = L.closed_card_agreement(bank.ledger, bank.closed, bank.case_txns)
    return one.withColumn("one", F.lit(1)).join(bad.withColumn("one", F.lit(1)), "one").drop("one")
