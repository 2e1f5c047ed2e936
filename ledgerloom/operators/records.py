"""What is written down about the ledger: audit entries, dimensions with stable keys, log records, and pages with their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safety import allowed_details
from .maintenance import CORRECTABLE
from .reads import url_key

LONGEST_AGENT = 255


def audit_entries(actions: DataFrame, allowed: list[str]) -> DataFrame:
    """Entries as they are stored, of actions (tenant_id, user_id, action, resource_type, resource_id, user_agent, succeeded, details, occurred_at).

    details (a map of strings) keep allowed keys only, and name the dropped ones under dropped_fields; without any they are
    null. A browser's name is cut to 255 characters, an empty one is null.
    """
    kept, dropped = allowed_details(F.col("details"), allowed)
    named = F.when(F.size(dropped) > 0, F.map_concat(kept, F.create_map(F.lit("dropped_fields"), F.array_join(dropped, ","))))
    details = F.when(F.size("details") > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(named, kept))))))
    agent = F.nullif(F.substring(F.coalesce("user_agent", F.lit("")), 1, LONGEST_AGENT), F.lit(""))
    return actions.withColumns({"details": details, "user_agent": agent, "succeeded": F.coalesce("succeeded", F.lit(True))})


def append_once(rows: DataFrame, path: str, request: str) -> None:
    """Appends rows to a stored table under the request's name; the same request again replaces its own rows."""
    named = rows.withColumn("request_id", F.lit(request))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request_id").parquet(path)


def correction_entries(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """tenant_id, txn_id, seq, field, old_value and new_value for each field that a correction changes.

    A correction is held against the one before it that named the field, or else against the ledger's value.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in CORRECTABLE))
    new = corrections.select("tenant_id", "txn_id", "seq", F.explode(fields).alias("f")).where("f.value is not null")
    old = ledger.select("tenant_id", "txn_id", F.lit(None).cast("long").alias("seq"), F.explode(fields).alias("f"))
    key = ["tenant_id", "txn_id", "field"]
    steps = new.select(*key[:2], F.col("seq").cast("long").alias("seq"), "f.field", "f.value").unionByName(old.select(*key[:2], "seq", "f.field", "f.value").join(new.select(*key[:2], "f.field").distinct(), key, "left_semi"))
    # Corrections of one field of one row are few; they are listed by their number.
    listed = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("seq"), "value"))).alias("steps"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("steps")), lambda i: F.struct(F.element_at("steps", i)["seq"].alias("seq"), F.element_at("steps", i - 1)["value"].alias("old"), F.element_at("steps", i)["value"].alias("new")))
    changed = listed.where(F.size("steps") > 1).select(*key, F.explode(pairs).alias("p")).where(~F.col("p.old").eqNullSafe(F.col("p.new")))
    return changed.select("tenant_id", "txn_id", "p.seq", "field", F.col("p.old").alias("old_value"), F.col("p.new").alias("new_value"))


def merged_dimension(table: DataFrame, seeds: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """The dimension after a seeding: seeds of a key (by) that the table has take its id and replace its other columns, others are added.

    Ids come of the kind and the key's names, so that a second seeding, or one elsewhere, changes nothing. Rows that the
    seeds lack stay. Seeds that repeat a key count once, the first by their columns.
    """
    rest = [c for c in table.columns if c not in ("id", *by)]
    once = seeds.groupBy(*by).agg(F.min(F.struct(*rest)).alias("s")).select(*by, "s.*")
    new = once.withColumn("id", url_key(F.concat_ws("/", F.lit(kind), *by))).select(table.columns)
    return table.join(new.select(*by), by, "left_anti").select(table.columns).unionByName(new)


def alias_rows(merchants: DataFrame) -> DataFrame:
    """merchant_id, pattern and priority of merchants (id, aliases): longer patterns are more specific and come first."""
    one = merchants.select(F.col("id").alias("merchant_id"), F.explode("aliases").alias("alias"))
    one = one.select("merchant_id", F.upper(F.trim("alias")).alias("pattern")).where("pattern <> ''").distinct()
    return one.withColumn("priority", F.greatest(F.lit(1), 200 - F.char_length("pattern")))


def page_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of the rows in this order, each with the number of all rows (total)."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def known_categories(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """The rows whose category is one of the categories (slug, name), with its name; rows without one go."""
    return ledger.join(categories.select(F.col("slug").alias("category"), F.col("name").alias("category_name")), "category")


def job_read(events: DataFrame, job_id: int, terminal: tuple[str, ...]) -> DataFrame:
    """One job (job_id, seq, occurred_at, state): its events, first and latest time, state, and whether it is over; no row if there is none."""
    own = events.where(F.col("job_id") == job_id).groupBy("job_id")
    rows = own.agg(F.count("*").alias("events"), F.min("occurred_at").alias("started_at"), F.max(F.struct("seq", "occurred_at", "state")).alias("last"))
    return rows.select("job_id", "events", "started_at", F.col("last.occurred_at").alias("updated_at"), "last.state", F.col("last.state").isin(*terminal).alias("closed"))


def period_of(text: Column) -> tuple[Column, Column]:
    """First and last day of a period written as YYYY-MM or YYYY, from 1990 to 2100; null where it is written otherwise."""
    year = F.regexp_extract(text, r"^(\d{4})(?:-\d{2})?$", 1).try_cast("int")
    good = year.between(1990, 2100)
    month = F.when(good & text.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$"), F.concat(text, F.lit("-01")).try_cast("date"))
    whole = F.when(good & text.rlike(r"^\d{4}$"), F.make_date(year, F.lit(1), F.lit(1)))
    return F.coalesce(month, whole), F.coalesce(F.last_day(month), F.add_months(whole, 12) - 1)
