"""What is written down about calls to models, and the narratives that pass. No model is called: its answers are the caller's frame.

Every answer is one row, judged by expressions and written by partition; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as V
from ..functions.money import cost_estimate
from ..functions.safety import untraceable
from .records import append_once

NARRATIVES = "tenant_id long, month string, narrative string, narrative_model string, narrative_generated_at timestamp, request_id string"


def payload_hash(payload: Column) -> Column:
    """SHA-256 of a map's JSON in the order of its names; entries without a value are not part of it."""
    held = F.array_sort(F.map_entries(F.map_filter(payload, lambda _, v: v.isNotNull())))
    return F.sha2(F.to_json(F.map_from_entries(held)), 256)


def fields_sent(payload: Column) -> Column:
    """The names in a map that have a value, in order, as JSON."""
    return F.to_json(F.array_sort(F.map_keys(F.map_filter(payload, lambda _, v: v.isNotNull()))))


def judged_calls(calls: DataFrame) -> DataFrame:
    """Calls with outcome (ok, provider_error or output_rejected), rejected_by, detector, category and confidence.

    calls: call_id, tenant_id, txn_id, at, model_name, model_version, payload (map of strings), answer, error_code,
    input_tokens, output_tokens, latency_ms. A provider's error is one whatever the answer says; a null answer without an
    error is no object. Repeated calls stay repeated.
    """
    said = calls.withColumn("_p", V.prediction(F.coalesce("answer", F.lit(""))))
    failed = F.col("error_code").isNotNull()
    outcome = F.when(failed, "provider_error").when(F.col("_p.rejected_by").isNotNull(), "output_rejected").otherwise("ok")
    kept = {c: F.when(~failed, F.col(f"_p.{c}")) for c in ("rejected_by", "detector", "category", "confidence")}
    return said.withColumns({"outcome": outcome, **kept}).drop("_p")


def call_records(judged: DataFrame, categories: DataFrame, provider: str, price_in: str, price_out: str) -> DataFrame:
    """One record a call as it is stored: names and a hash of what was sent, never its content.

    categories: slug (each once) and category_id; a slug that they lack leaves the id null. Tokens that are null cost nothing.
    """
    ids = categories.select(F.col("slug").alias("category"), F.col("category_id").alias("predicted_category_id"))
    tokens = [F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens")]
    return judged.join(ids, "category", "left").select(
        "call_id", "tenant_id", "txn_id", "at", F.lit(provider).alias("provider"), "model_name", "model_version", F.lit("categorize").alias("purpose"),
        payload_hash(F.col("payload")).alias("payload_hash"), fields_sent(F.col("payload")).alias("fields_sent"), "predicted_category_id",
        F.col("confidence").alias("predicted_confidence"), (F.col("outcome") == "ok").alias("accepted"), *(t.alias(n) for t, n in zip(tokens, ("input_tokens", "output_tokens"))),
        cost_estimate(*tokens, price_in, price_out).alias("cost"), "latency_ms", "outcome", F.coalesce("error_code", "rejected_by").alias("error_code"),
    )


def incident_records(judged: DataFrame, stage: str) -> DataFrame:
    """What fired on the judged rows, by its detector and never by what it matched: tenant_id, at, kind, detector, context.

    judged: outcome, rejected_by and detector of judged_calls() or judged_narratives(). Sensitive data in an answer and in
    what was to be sent, figures that nothing backs and answers of a wrong shape are incidents; a provider's error is none.
    """
    kind = (
        F.when(F.col("outcome") == "pii_in_payload", "pii_in_payload").when(F.col("outcome") == "untraceable_figure", "output_untraceable_figure")
        .when((F.col("outcome") == "output_rejected") & (F.col("rejected_by") == "pii_echo"), "output_pii_echo")
        .when((F.col("outcome") == "output_rejected") & (F.col("rejected_by") != "unexpected_tool_call"), "output_schema_violation")
    )
    context = F.to_json(F.struct(F.lit(stage).alias("stage"), "outcome"))
    fired = judged.withColumn("kind", kind).where("kind is not null")
    return fired.select("tenant_id", "at", "kind", F.coalesce("detector", "rejected_by").alias("detector"), context.alias("context"))


def usage_by_day(records: DataFrame) -> DataFrame:
    """Calls, accepted and rejected answers, tokens and cost of each tenant and day."""
    return records.groupBy("tenant_id", F.to_date("at").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("outcome") == "output_rejected").alias("outputs_rejected"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast("decimal(18,6)").alias("cost"),
    )


def told(view: Column) -> Column:
    """A view (a map of strings) as the text that answers are held against: names in _rupees are money, names in _percent percentages."""
    amount = lambda v: F.regexp_replace(v, "^-", "")
    shown = lambda k, v: F.when(k.endswith("_rupees"), F.concat(F.lit("₹"), amount(v))).when(k.endswith("_percent"), F.concat(amount(v), F.lit("%"))).otherwise(v)
    return F.array_join(F.map_values(F.transform_values(view, shown)), "\n")


def judged_narratives(answers: DataFrame) -> DataFrame:
    """Answers with outcome, rejected_by, detector and narrative, which is null unless the outcome is ok.

    answers: tenant_id, month (yyyy-MM), at, view (map of strings; figures end in _rupees, _percent or _count), text,
    tool_calls, error_code, model_name. In turn: the view holds what must not be sent; the provider failed; tools were called
    though none was offered; the prose is rejected; it holds a figure that the view lacks. A null view backs no figure.
    """
    by, kind = V.rejected_prose(F.col("text"))
    # Numbers under a figure's name are the engine's own; whatever else a view holds is scanned.
    figure = lambda k, v: k.rlike("_(?:rupees|percent|count)$") & v.rlike(r"^-?\d+(?:\.\d+)?$")
    scanned = F.map_filter("view", lambda k, v: ~F.coalesce(figure(k, v), F.lit(False)))
    held = F.coalesce(F.map_values(scanned), F.array().cast("array<string>"))
    marked = answers.withColumns({"_blocked": V.blocked_view(held), "_by": by, "_kind": kind})
    marked = marked.withColumn("_loose", untraceable(F.trim("text"), F.coalesce(told(F.col("view")), F.lit(""))))
    outcome = (
        F.when(F.col("_blocked").isNotNull(), "pii_in_payload").when(F.col("error_code").isNotNull(), "provider_error")
        .when((F.coalesce("tool_calls", F.lit(0)) > 0) | F.col("_by").isNotNull(), "output_rejected").when(F.size("_loose") > 0, "untraceable_figure").otherwise("ok")
    )
    judged = marked.withColumn("outcome", outcome)
    rejected = F.when(F.col("outcome") == "output_rejected", F.when(F.coalesce("tool_calls", F.lit(0)) > 0, "unexpected_tool_call").otherwise(F.col("_by")))
    kinds = F.array_join(F.array_distinct(F.transform("_loose", lambda f: F.substring_index(f, ":", 1))), ",")
    detector = F.when(F.col("outcome") == "pii_in_payload", F.col("_blocked")).when(F.col("outcome") == "untraceable_figure", kinds).when(rejected == "pii_echo", F.col("_kind"))
    text = F.when(F.col("outcome") == "ok", F.trim("text"))
    return judged.withColumns({"rejected_by": rejected, "detector": detector, "narrative": text}).drop("_blocked", "_by", "_kind", "_loose")


def store_narratives(judged: DataFrame, snapshots: DataFrame, path: str, request: str) -> None:
    """Stores the narratives that passed, of months with a snapshot (tenant_id, month); the same request again replaces its own.

    They stand beside the snapshots, so rebuilding a month's figures leaves its narrative, and nothing stored is read to write.
    """
    good = judged.where("outcome = 'ok'").join(snapshots.select("tenant_id", "month").distinct(), ["tenant_id", "month"], "left_semi")
    rows = good.select("tenant_id", "month", "narrative", F.col("model_name").alias("narrative_model"), F.col("at").alias("narrative_generated_at"))
    append_once(rows, path, request)


def stored_narratives(stored: DataFrame) -> DataFrame:
    """The newest narrative of each tenant and month as text, model_name and generated_at; of equal times the greatest text."""
    last = F.max(F.struct("narrative_generated_at", "narrative", "narrative_model")).alias("n")
    rows = stored.where("narrative <> ''").groupBy("tenant_id", "month").agg(last)
    at = F.date_format("n.narrative_generated_at", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("tenant_id", "month", F.col("n.narrative").alias("text"), F.col("n.narrative_model").alias("model_name"), at.alias("generated_at"))


def import_message(inserted: Column, duplicates: Column, trust: Column) -> Column:
    """One sentence about an import, which claims no more than its reconciliation showed."""
    # The four sentences.
    added = lambda how: F.concat(inserted.cast("string"), F.lit(f" transactions added · {how}"))
    known = F.concat(F.lit("Already imported — "), duplicates.cast("string"), F.lit(" duplicate rows skipped"))
    checked = F.when(trust == "trusted", added("reconciles exactly")).when(trust == "untrusted", added("does not reconcile"))
    return F.when((inserted == 0) & (duplicates > 0), known).otherwise(F.coalesce(checked, added("arithmetic could not be checked")))


def import_metrics(imports: DataFrame, rows: DataFrame) -> DataFrame:
    """metric, label, value and n: what imports add to counters, each label a shape and never a name or an amount.

    imports: statement_id, bank, page_count, delta, trust_status; rows: statement_id, review_status, category_source. Deltas
    are counted by the first edge of 0, 1, 100 and 10000 paise that holds them, so 0 means that a statement passed.
    """
    counted = lambda name, label, n: F.struct(F.lit(name).alias("metric"), F.col("bank").alias("label"), label.cast("string").alias("value"), n.cast("long").alias("n"))
    paise = F.abs(F.col("delta")) * 100
    edge = F.when(paise <= 0, "0").when(paise <= 1, "1").when(paise <= 100, "100").when(paise <= 10000, "10000").otherwise("over")
    of_import = F.array(
        counted("pages_processed", F.lit("text"), F.coalesce("page_count", F.lit(0))),
        F.when(F.col("delta").isNotNull(), counted("reconciliation_delta_paise", edge, F.lit(1))),
        F.when(F.col("trust_status") != "trusted", counted("validation_failures", F.lit("reconciliation"), F.lit(1))),
    )
    banks = imports.select("statement_id", "bank")
    of_rows = rows.groupBy("statement_id", "review_status", "category_source").agg(F.count("*").alias("c")).join(banks, "statement_id")
    of_row = F.array(counted("transactions_ingested", F.col("review_status"), F.col("c")), counted("categorization", F.col("category_source"), F.col("c")))
    both = imports.select(F.explode(of_import).alias("m")).unionByName(of_rows.select(F.explode(of_row).alias("m"))).where("m is not null and m.value is not null")
    return both.select("m.*").groupBy("metric", "label", "value").agg(F.sum("n").alias("n"))


def sent_fields(sent: DataFrame, fields: list[str]) -> DataFrame:
    """field, allowed order, how many payloads held a value there, and how many did not; payloads that were blocked (null) count in neither.

    sent: payload, a struct of these fields.
    """
    one = lambda i, f: F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f"payload.{f}").isNotNull().alias("held"))
    each = sent.where("payload is not null").select(F.explode(F.array(*(one(i, f) for i, f in enumerate(fields)))).alias("f"))
    return each.groupBy("f.place", "f.field").agg(F.count_if("f.held").alias("sent"), F.count_if(~F.col("f.held")).alias("withheld"))
