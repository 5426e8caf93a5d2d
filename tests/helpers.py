"""Small ledgers as literal rows."""
from ledgerlens.params import HOUR

SCHEMA = ("TransactionID string, us bigint, TransactionDT bigint, TransactionAmt double, ProductCD string, channel string, customer_id string, "
          "card_id string, risk_score double, p_txn double, addr1 string, addr2 string, P_emaildomain string, R_emaildomain string, D1 double, "
          "M4 string, M6 string, id_15 string, id_23 string, device_profile_id string, has_device_record boolean")
DEVICE = "Samsung Galaxy S8|Android 8.0|chrome|2220x1080"


def row(i, us, amount, customer="C00001", card=None, channel="online", p=0.1, addr="444", device=None, **kw):
    base = dict(TransactionID=str(i), us=us, TransactionDT=us // 1_000_000, TransactionAmt=float(amount), ProductCD="C", channel=channel,
                customer_id=customer, card_id=card or f"{customer}-K1", risk_score=0.8, p_txn=float(p), addr1=addr, addr2="87",
                P_emaildomain="gmail.com", R_emaildomain=None, D1=1.0, M4=None, M6=None, id_15=None, id_23=None, device_profile_id=device,
                has_device_record=device is not None)
    base.update(kw)
    return base


def ledger(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def hours(h):
    return int(h * HOUR)
