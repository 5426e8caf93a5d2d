"""Ledger construction: readers with declared schemas, card numbering, joins, sinks, key checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import code_text, device_key, micros
from . import schema as S


def read_csv(spark: SparkSession, path: str, schema, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema, matched to the file's columns by name."""
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in schema.fields}
    wanted = [c for c in (columns or types) if c in header]
    text = spark.read.option("header", True).csv(path)
    return text.select(*[F.col(c).try_cast(types[c]).alias(c) for c in wanted])


def number_cards(df: DataFrame, card_cols: list[str], customer: str = "customer_id") -> DataFrame:
    """Add ``card_id``: customer and the rank of the card tuple among the customer's tuples.

    The tuples are made distinct before anything is ranked, so the window sees a handful of rows per
    customer however many transactions the customer has.
    """
    df = df.withColumns({c: code_text(F.col(c)) for c in card_cols})
    tuples = df.select(customer, *card_cols).distinct()
    rank = F.row_number().over(W.partitionBy(customer).orderBy(*card_cols))
    cards = tuples.withColumn("card_id", F.concat(F.col(customer), F.lit("-K"), rank.cast("string")))
    return df.join(cards, [customer, *card_cols], "left")


def number_cards_by_first_use(df: DataFrame, card_cols: list[str], customer: str = "customer_id") -> DataFrame:
    """Card numbering in order of each tuple's first transaction."""
    df = df.withColumns({c: code_text(F.col(c)) for c in card_cols})
    firsts = df.groupBy(customer, *card_cols).agg(F.min(F.struct("us", "TransactionID")).alias("_first"))
    rank = F.row_number().over(W.partitionBy(customer).orderBy("_first"))
    cards = firsts.withColumn("card_id", F.concat(F.col(customer), F.lit("-K"), rank.cast("string"))).drop("_first")
    return df.join(cards, [customer, *card_cols], "left")


def read_raw_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Official layout: ``transactions.csv`` and ``identity.csv``."""
    txns = read_csv(spark, f"{folder}/transactions.csv", S.TRANSACTIONS)
    ident = read_csv(spark, f"{folder}/identity.csv", S.IDENTITY)
    ident = ident.withColumn("device_profile_id", device_key(*[F.col(c) for c in S.DEVICE_PARTS])).drop(
        *S.DEVICE_PARTS)
    cards = [c for c in S.CARD_COLS if c in txns.columns]
    led = number_cards(txns, cards).join(ident, "TransactionID", "left")
    return finish_ledger(led.withColumn("has_device_record", F.col("device_profile_id").isNotNull()).drop(*cards))


def read_prepared_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared layout: three narrow CSV files sharing ``TransactionID``."""
    core = read_csv(spark, f"{folder}/transactions_core.csv", S.LEDGER_CSV)
    ident = read_csv(spark, f"{folder}/identity_signals.csv", S.LEDGER_CSV).drop("device_profile_id")
    signals = read_csv(spark, f"{folder}/transactions_signals.csv", S.LEDGER_CSV)
    return finish_ledger(core.join(ident, "TransactionID", "left").join(signals, "TransactionID", "left"))


def finish_ledger(df: DataFrame) -> DataFrame:
    return df.withColumns({"us": micros(F.col("ts")), "day": F.to_date("ts"),
                           "addr1": F.nullif(code_text(F.col("addr1")), F.lit(""))})


def exists(spark: SparkSession, path: str) -> bool:
    """True when a path or pattern matches something (any file system Spark knows); other errors are raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def build_store(spark: SparkSession, folder: str, out: str, force: bool = False,
                alerts: DataFrame | None = None) -> DataFrame:
    """Write the ledger once, partitioned by day; rebuild only with ``force``."""
    if exists(spark, f"{out}/*/*.parquet") and not force:
        return spark.read.parquet(out)
    raw = exists(spark, f"{folder}/transactions.csv")
    led = read_raw_ledger(spark, folder) if raw else read_prepared_ledger(spark, f"{folder}/prepared")
    if alerts is not None:
        require_alert_cards(led, alerts)
    write_ledger(led, out)
    return spark.read.parquet(out)


def write_ledger(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Parquet by day. ``rebalance`` lets AQE split heavy days over several files."""
    df.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(out)


def read_closed_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed case headers and the exploded ``(case_id, TransactionID)`` table."""
    c = read_csv(spark, path, S.CLOSED_CASES)
    c = c.withColumns({"opened_us": micros(F.col("opened_at")), "closed_us": micros(F.col("closed_at")),
                       "connected_card_ids": split_list(F.col("connected_card_ids"))})
    members = c.select("case_id", F.explode(split_list(F.col("txn_ids"))).alias("TransactionID"))
    return c.drop("txn_ids"), members


def split_list(text: Column) -> Column:
    """Pipe-separated text to an array; empty or null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: x != "")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.ALERTS).withColumn("opened_us", micros(F.col("opened_at")))


def row_cap(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows by time and id."""
    return df.orderBy("us", "TransactionID").limit(n)


def alert_card_mismatches(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts whose flagged transaction is missing from the ledger or sits on another card."""
    built = ledger.select(F.col("TransactionID").alias("flagged_txn_id"), F.col("card_id").alias("built_card"))
    j = alerts.select("case_id", "flagged_txn_id", "card_id").join(built, "flagged_txn_id", "left")
    return j.filter(~F.col("card_id").eqNullSafe(F.col("built_card")))


def require_alert_cards(ledger: DataFrame, alerts: DataFrame) -> None:
    bad = alert_card_mismatches(ledger, alerts).take(3)
    if bad:
        raise ValueError(f"card numbering does not match the alerts, e.g. {bad}")


def closed_card_agreement(ledger: DataFrame, closed: DataFrame, members: DataFrame) -> DataFrame:
    """One row: cases, cases whose card occurs among the cards of their transactions, and the rate."""
    cards = members.join(ledger.select("TransactionID", F.col("card_id").alias("txn_card")), "TransactionID")
    pairs = cards.select("case_id", F.col("txn_card").alias("card_id")).distinct().withColumn("hit", F.lit(1))
    j = closed.select("case_id", "card_id").filter(F.col("card_id").isNotNull()).join(
        pairs, ["case_id", "card_id"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_cases"), F.count("hit").alias("n_match"),
                 F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("rate"))


def append_case_memory(records: DataFrame, out: str) -> None:
    records.write.mode("append").parquet(out)


def latest_case_memory(memory: DataFrame, order: str = "written_us") -> DataFrame:
    """Last write wins per case; the pick is an aggregate, so repeated writes shrink map-side."""
    cols = [c for c in memory.columns if c != "case_id"]
    g = memory.groupBy("case_id").agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select("case_id", *[F.col(f"_r.{c}").alias(c) for c in cols])
