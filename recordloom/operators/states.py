"""State log, result store and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions.joins import lookup_join
from recordloom.functions.rows import first_rows

_CODES = len(model.STATUS_RANK)


def status_rank(status: str = "status") -> Column:
    """The place of a status among those of one moment; one outside the four is last."""
    rank = F.lit(_CODES)
    for name, value in model.STATUS_RANK.items():
        rank = F.when(F.col(status) == name, value).otherwise(rank)
    return rank


def transition_code(status: str = "status", created_at: str = "created_at") -> Column:
    """Time and status of a transition as one integer that orders transitions.

    An integer is aggregated in a hash table, where a struct or a string would
    make Spark sort the whole log first.
    """
    rank = F.lit(None).cast("int")
    for name, value in model.STATUS_RANK.items():
        rank = F.when(F.col(status) == name, value).otherwise(rank)
    return F.unix_micros(F.col(created_at).cast("timestamp")) * _CODES + rank


def code_status(code: Column) -> Column:
    names = [F.lit(n) for n, _ in sorted(model.STATUS_RANK.items(), key=lambda item: item[1])]
    return F.get(F.array(*names), F.pmod(code, F.lit(_CODES)).cast("int"))


def code_time(code: Column) -> Column:
    micros = F.floor((code - F.pmod(code, F.lit(_CODES))) / _CODES)
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def state_rows(requests: DataFrame, status: Column | str, at: Column) -> DataFrame:
    """M1: one transition per request, ready to append."""
    status = F.lit(status) if isinstance(status, str) else status
    return requests.select("request_id", status.alias("status"), at.alias("created_at"))


def latest_states(states: DataFrame) -> DataFrame:
    """M2: newest state of each request. The maximum is taken on the map side
    first, so a request with very many transitions is one row per task at the
    shuffle. A status outside the four is returned like them where it is newest
    (at equal times it wins over a known one); rows with one are few, so they are
    reduced apart."""
    known = F.col("status").isin(*model.STATUS_RANK)
    newest = states.groupBy("request_id").agg(F.max(transition_code()).alias("_code"))
    other = first_rows(
        states.filter(~known | F.col("status").isNull()).select(
            "request_id", F.col("status").alias("_other"), F.col("created_at").alias("_at")
        ),
        ["request_id"],
        [F.col("_at").desc()],
    )
    time = code_time(F.col("_code"))
    later = F.col("_at").isNotNull() & (F.col("_code").isNull() | (F.col("_at") >= time))
    return newest.join(other, "request_id", "left").select(
        "request_id",
        F.when(later, F.col("_other")).otherwise(code_status(F.col("_code"))).alias("status"),
        F.when(later, F.col("_at")).otherwise(time).alias("created_at"),
    )


def latest_results(results: DataFrame, written: str = "written_at") -> DataFrame:
    """M4: the last result written for each request wins; at equal times the later
    attempt, then the content decides, so a rerun gives the same row."""
    order = [F.col(written).desc()]
    if "attempt" in results.columns:
        order.append(F.col("attempt").desc())
    return first_rows(results, ["request_id"], order)


def get_results(states: DataFrame, results: DataFrame) -> DataFrame:
    """M3: latest state; with data when COMPLETED, with the error when FAILED.

    ``results`` holds one row per request (see ``latest_results``). Both sides
    are unique and hashed on request_id, so the second shuffle is avoided by
    the partitioning ``latest_states`` leaves behind.
    """
    payload = results.select("request_id", "result", "error")
    df = latest_states(states).join(payload, "request_id", "left")
    return df.select(
        "request_id",
        "status",
        "created_at",
        F.when(F.col("status") == model.COMPLETED, F.col("result")).alias("data"),
        F.when(F.col("status") == model.FAILED, F.col("error")).alias("error"),
    )


def results_for(asked: DataFrame, states: DataFrame, results: DataFrame) -> DataFrame:
    """M3 for a list of request ids; an unknown id gets an error row."""
    ids = asked.select("request_id").distinct()
    known = lookup_join(states, ids, ["request_id"], "left_semi", spread_by=("created_at",))
    wanted = lookup_join(results, ids, ["request_id"], "left_semi")
    found = get_results(known, wanted)
    name, message = model.REQUEST_DOES_NOT_EXIST
    missing = F.col("status").isNull()
    unknown = F.struct(F.lit(name).alias("error_name"), F.lit(message).alias("error_message"))
    return (
        ids.join(found, "request_id", "left")
        .withColumn("error", F.when(missing, unknown).otherwise(F.col("error")))
    )


def harvest(asked: DataFrame, states: DataFrame, results: DataFrame) -> DataFrame:
    """M8: every listed request with its record, or with the reason it has none."""
    found = results_for(asked, states, results)
    reason = F.coalesce(F.col("error.error_name"), F.col("status"))
    return found.select(
        "request_id", "data", F.when(F.col("data").isNull(), reason).alias("reason")
    )


def outcome_metrics(outcomes: DataFrame, unit: str = "day") -> DataFrame:
    """M5: success and failure counters per operation and time unit.

    Expects operation, ok, at.
    """
    return outcomes.groupBy("operation", F.date_trunc(unit, "at").alias("period")).agg(
        F.count_if(F.col("ok")).alias("success"), F.count_if(~F.col("ok")).alias("failed")
    )


def status_code(column: str = "error_name") -> Column:
    """M6: 400 for the known client errors, 500 for anything else, 200 for none."""
    name = F.col(column)
    return (
        F.when(name.isNull(), 200).when(name.isin(*model.CLIENT_ERRORS), 400).otherwise(500)
    )


def error_taxonomy(errors: DataFrame) -> DataFrame:
    """M6: number of errors by name and status code."""
    return (
        errors.filter(F.col("error_name").isNotNull())
        .groupBy("error_name")
        .agg(F.count("*").alias("occurrences"))
        .withColumn("status_code", status_code())
    )


def envelope(result: Column, error_name: Column, error_message: Column) -> Column:
    """M7: the JSON reply, ``result`` being the JSON text of the data."""
    ok = F.to_json(
        F.struct(F.lit(True).alias("OK"), F.try_parse_json(result).alias("result"))
    )
    failed = F.to_json(
        F.struct(
            F.lit(False).alias("OK"),
            F.struct(
                error_name.alias("error_name"), error_message.alias("error_message")
            ).alias("error"),
        )
    )
    return F.when(error_name.isNull(), ok).otherwise(failed)


def status_counts(states: DataFrame) -> DataFrame:
    """Requests by latest status."""
    return latest_states(states).groupBy("status").agg(F.count("*").alias("requests"))
