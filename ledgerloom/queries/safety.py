"""Text safety over documents and conversations, narration functions, and stream-shaped batch queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import narration as T
from ..functions import safety as D
from ..streaming import jobs
from ..streaming import tables as W
from .registry import query


#: Rows of whole texts that go to a Python worker at once, which bounds a worker's memory whatever a partition holds.
TEXTS_A_BATCH = 1_000


def _docs(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_A_BATCH:
        spark.conf.set(key, TEXTS_A_BATCH)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("D1_pii_scan")
def pii_scan(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(D.scan("text")).alias("s"))
    return found.select("doc_id", "s.kind", "s.start", "s.end")


@query(
    "D2_verhoeff",
    f"""WITH t AS (SELECT {list(D.PRODUCT)} AS product, {list(D.PERMUTATION)} AS permutation),
 d AS (SELECT event_id, ((2 + event_id % 8)::BIGINT * 100000000000 + (event_id * 7919) % 100000000000)::VARCHAR AS n FROM events)
SELECT event_id, n AS number, list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: permutation[(i % 8) * 10 + substr(reverse(n), (i + 1)::INT, 1)::INT + 1])),
  lambda a, x: product[a * 10 + x + 1]) = 0 AS valid FROM d, t""",
)
def verhoeff(spark, sf_dir):
    k = F.col("event_id")
    number = ((2 + k % 8) * 100_000_000_000 + (k * 7919) % 100_000_000_000).cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", number.alias("number"), D.verhoeff_valid(number).alias("valid"))


@query(
    "D3_luhn",
    """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\\d[ -]?){12,18}\\d')) AS token FROM documents),
 b AS (SELECT doc_id, token, regexp_replace(token, '\\D', '', 'g') AS n FROM d)
SELECT doc_id, token, length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(reverse(n), i, 1)::INT WHEN substr(reverse(n), i, 1)::INT > 4 THEN 2 * substr(reverse(n), i, 1)::INT - 9
       ELSE 2 * substr(reverse(n), i, 1)::INT END)) % 10 = 0 AS luhn FROM b""",
)
def checksums(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:\d[ -]?){12,18}\d"), 0)).alias("token"))
    return tokens.select("doc_id", "token", D.luhn_valid(F.col("token")).alias("luhn"))


@query("D4_redaction")
def redaction(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(D.redact("text")).alias("redacted"), F.md5(D.redact_for_logs("text")).alias("for_logs"))


@query(
    "D5_injection_guard",
    "SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN NULL WHEN length(text) > 160 THEN 'oversized_text' "
    + " ".join(f"WHEN regexp_matches(text, '(?i){pattern}') THEN '{name}'" for name, pattern in D.INJECTIONS)
    + r" WHEN regexp_matches(text, '[\x00-\x1F\x{200B}-\x{200F}]') THEN 'hidden_characters' END AS reason FROM conversations",
)
def injection_guard(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", D.injection_reason(F.col("text")).alias("reason"))


@query("F7_collapse", """SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x{2007}\\x{202F}]+', ' ', 'g'))) AS collapsed FROM documents""")
def collapsed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapse("text")).alias("collapsed"))


@query("F8_F9_F12_narration_tokens")
def narration_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", T.strip_machine_noise("text").alias("bare"), F.size(T.split_tokens("text")).alias("fields"), T.residue("text").alias("residue"))


def narrations(spark, sf_dir):
    """Narrations built from the tables: a rail, a supplier as merchant, and a reference."""
    rails = F.array(*map(F.lit, ("UPI-", "POS ", "NEFT-", "ATM WDL ", "IMPS/", "ACH ", "SALARY ", "EMI ")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    rail = F.element_at(rails, (F.col("o_orderkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("Customer "), F.lpad((F.col("o_custkey") % 50).cast("string"), 3, "0"))
    return rows.select("o_orderkey", F.concat(rail, F.upper(name), F.lit(" MUMBAI 00"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("description"))


RAIL_SQL = "CASE o_orderkey % 8 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'neft' WHEN 3 THEN 'atm' WHEN 4 THEN 'imps' WHEN 5 THEN 'ach' ELSE 'unknown' END"


@query(
    "F11_F13_F15_J14_merchants",
    f"""WITH o AS (SELECT o_orderkey, lpad((o_custkey % 50)::VARCHAR, 3, '0') AS c, {RAIL_SQL} AS rail FROM orders)
SELECT o_orderkey, rail, CASE WHEN c < '040' THEN 'Customer No ' || c WHEN rail <> 'atm' THEN 'Customer No 000' END AS merchant,
  CASE WHEN c < '040' THEN 'c' || c WHEN rail <> 'atm' THEN 'c000' END AS slug, CASE WHEN c < '040' THEN 0.99 WHEN rail = 'atm' THEN 0.90 ELSE 0.95 END::DOUBLE AS merchant_confidence,
  CASE o_orderkey % 8 WHEN 3 THEN 'cash_withdrawal' WHEN 6 THEN 'salary' WHEN 7 THEN 'emi' END AS rule FROM o""",
)
def merchants(spark, sf_dir):
    ids = F.explode(F.sequence(F.lit(0), F.lit(39)))
    number = F.lpad(F.col("i").cast("string"), 3, "0")
    aliases = spark.range(1).select(ids.alias("i")).select(
        F.concat(F.lit("Customer "), number).alias("alias"), F.concat(F.lit("c"), number).alias("slug"), F.concat(F.lit("Customer No "), number).alias("name")
    )
    rows = T.normalize_merchants(narrations(spark, sf_dir), aliases, "o_orderkey", keep=W.kept)
    return rows.select("o_orderkey", "rail", "merchant", "slug", F.col("merchant_confidence").cast("double").alias("merchant_confidence"), T.narration_rule("description")["code"].alias("rule"))


@query(
    "F4_F5_cells",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -1 WHEN 3 THEN -1 ELSE 1 END * o_totalprice::DECIMAL(18,2) AS amount,
  CASE o_orderkey % 4 WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' ELSE 'debit' END AS direction, o_orderdate::DATE AS day FROM orders""",
)
def cells(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shown = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    k, d = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    cell = F.when(k == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 1, F.concat(F.lit("Rs. "), shown, F.lit(" Cr"))).when(k == 2, F.concat(F.lit("₹"), shown, F.lit(" Dr."))).otherwise(F.concat(shown, F.lit("-")))
    formats = [F.date_format(d, f) for f in ("dd/MM/yyyy", "dd-MM-yy", "d MMM yyyy", "yyyy-MM-dd", "ddMMMyyyy")]
    day = F.element_at(F.array(*formats), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = rows.select("o_orderkey", cell.alias("cell"), day.alias("day"))
    return rows.select("o_orderkey", T.parse_amount("cell").alias("amount"), T.amount_direction("cell").alias("direction"), T.parse_date("day").alias("day"))


@query("W6_W7_latest_per_key", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "W10_sliding_rate",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events",
)
def sliding_rate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", jobs.whole_second("ts"))
    return rows.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)).alias("n"))


@query("T3_notification_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def notification_dedup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("D11_traceability")
def traceability(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = Window.partitionBy("conv_id").orderBy("turn")
    told = rows.withColumn("told", F.coalesce(F.lag("text").over(order), F.lit("")))
    # Every turn is held against the one before, as an answer against what it was told.
    return told.select("conv_id", "turn", D.untraceable(F.col("text"), F.col("told")).alias("untraceable"))


@query("U1_union_counts", "SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def union_counts(spark, sf_dir):
    names = ("documents", "pages", "conversations")
    frames = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("source"), F.count("*").alias("n")) for t in names]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
