"""Derived columns that look along a party's requests (M16, M17), and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.filters import settled

#: A growth this far below zero is a compaction, not a result of calls (fixed value).
DROP = 5_000
PARTY = ("session_id", "agent_id")

RATES_DDL = "model string, input double, cache_read double, write_5m double, write_1h double, output double, long_from bigint, long_input double, long_output double"


def request_cache(requests: DataFrame, compactions: DataFrame) -> DataFrame:
    """M17 (request_id, gap_ms, entry_ttl, expected_read, outcome, cause): each settled request against its party's one before.

    The latest earlier writer's lifetime is carried in a struct, so that a writer without a split hides older ones. Parties are
    windows over one shuffle; a compaction between two requests is found by a union in time order instead of a range join.
    """
    order = Window.partitionBy(*PARTY).orderBy("ts", "kind", "request_id")
    fields = ["request_id", *PARTY, "ts", "model", "cache_read_tokens", "context_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens"]
    rows = settled(requests).where("ts is not null").select(*fields, F.lit(1).alias("kind"))
    marks = compactions.where("ts is not null").select(*PARTY, "ts", F.lit(0).alias("kind"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_request, writes = F.col("kind") == 1, F.col("cache_creation_tokens") > 0
    ttl = F.when((F.col("cache_creation_5m_tokens") > 0) & (F.col("cache_creation_1h_tokens") > 0), "mixed").when(F.col("cache_creation_1h_tokens") > 0, "1h").when(F.col("cache_creation_5m_tokens") > 0, "5m")
    seen = both.select(
        "*",
        F.last(F.when(is_request, F.struct(F.col("ts").alias("ts"), F.col("model").alias("model"), F.col("context_tokens").alias("context"))), ignorenulls=True).over(before).alias("prev"),
        F.last(F.when(is_request & writes, F.struct(ttl.alias("ttl"))), ignorenulls=True).over(before).alias("writer"),
        F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(before).alias("compacted"),
    ).where(is_request)
    read, expected = F.col("cache_read_tokens"), F.col("prev.context")
    outcome = F.when(F.col("prev").isNull(), "first").when(expected.isNull() | read.isNull(), None).when(read * 100 >= expected * 95, "hit").when(read * 100 >= expected * 50, "partial").otherwise("miss")
    judged = seen.select("request_id", (F.col("ts") - F.col("prev.ts")).alias("gap_ms"), F.col("writer.ttl").alias("entry_ttl"), expected.alias("expected_read"), outcome.alias("outcome"), "model", "prev", "compacted")
    life = F.when(F.col("entry_ttl") == "1h", 3_600_000).when(F.col("entry_ttl").isin("5m", "mixed"), 300_000)
    cause = (
        F.when(~F.coalesce(F.col("outcome").isin("partial", "miss"), F.lit(False)), None)
        .when(F.col("model") != F.col("prev.model"), "model_changed")
        .when(F.col("compacted") > F.col("prev.ts"), "compacted")
        .when(F.col("gap_ms") > life, "expired")
        .otherwise("unknown")
    )
    return judged.select("request_id", "gap_ms", "entry_ttl", "expected_read", "outcome", cause.alias("cause"))


def normal_model(model: Column) -> Column:
    """A model name as rates have it: lower case, without a [tag], dots as dashes where the name starts with claude."""
    bare = F.regexp_replace(F.lower(model), r"\[[^\]]*\]$", "")
    return F.when(bare.startswith("claude"), F.replace(bare, F.lit("."), F.lit("-"))).otherwise(bare)


def priced(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """Requests with `table_micros` and `write_rate` (USD a token), from rates in USD a million tokens.

    A model is looked up by its normal name, then without a date suffix; an unknown one has neither. From long_from context
    tokens on the long rates hold. Cache writes without a split cost the 5-minute rate. Unknown tokens give an unknown price.
    """
    named = requests.withColumn("_name", normal_model(F.col("model"))).withColumn("_bare", F.regexp_replace("_name", r"-\d{8}$", ""))
    r = rates.select(*[F.col(c).alias(f"_{c}") for c in rates.columns])
    exact = named.join(r.withColumnRenamed("_model", "_name"), "_name", "left")
    left = exact.where("_input is null").select(*named.columns).join(r.withColumnRenamed("_model", "_bare"), "_bare", "left")
    joined = exact.where("_input is not null").unionByName(left)
    long = F.coalesce(F.col("context_tokens") >= F.col("_long_from"), F.lit(False))
    inp, out = F.when(long, F.col("_long_input")).otherwise(F.col("_input")), F.when(long, F.col("_long_output")).otherwise(F.col("_output"))
    scale = inp / F.col("_input")
    split = F.coalesce("cache_creation_5m_tokens", F.lit(0)) + F.coalesce("cache_creation_1h_tokens", F.lit(0))
    w5 = F.when(split > 0, F.coalesce("cache_creation_5m_tokens", F.lit(0))).otherwise(F.col("cache_creation_tokens"))
    w1 = F.when(split > 0, F.coalesce("cache_creation_1h_tokens", F.lit(0))).otherwise(F.lit(0))
    writes = w5 * F.col("_write_5m") * scale + w1 * F.col("_write_1h") * scale
    micros = F.round(F.col("input_tokens") * inp + F.col("cache_read_tokens") * F.col("_cache_read") * scale + writes + F.col("output_tokens") * out).cast("long")
    rate = F.when(F.col("_input").isNotNull(), F.when(w5 + w1 > 0, writes / (w5 + w1)).otherwise(F.col("_write_5m") * scale) / 1_000_000)
    return joined.select(*requests.columns, micros.alias("table_micros"), rate.alias("write_rate"))


def apply_prices(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """A ledger price stays; else the table's price of the row's tokens, if there is one; else what is stored. Names starting gpt- count too."""
    stays = F.col("cost_source").eqNullSafe("ledger") & F.col("cost_usd_micros").isNotNull()
    found = priced(requests, rates)
    cost = F.when(stays, F.col("cost_usd_micros")).otherwise(F.coalesce("table_micros", "cost_usd_micros"))
    source = F.when(stays, "ledger").when(F.col("table_micros").isNotNull(), "table").otherwise(F.col("cost_source"))
    return found.select(*[c for c in requests.columns if c not in ("cost_usd_micros", "cost_source")], cost.alias("cost_usd_micros"), source.alias("cost_source"))


def call_results(calls: DataFrame, requests: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """M16 (tool_use_id, result_tokens, result_basis, result_write_micros): what each call's result added to its party's context.

    The growth from a call's request to the party's next, less the request's output and not below zero, is unknown if the context fell
    by more than DROP, at the latest request, and while either request is pending. One call takes all of it (exact). Several share it
    by delivered bytes (split): each gets the difference of rounded running shares in the order of their ids, so that shares
    add up; they are unknown if a size is or if all are zero. The write price is the next request's.
    """
    party = Window.partitionBy(*PARTY).orderBy("ts", "request_id")
    own = requests.where("ts is not null").where(~F.col("source").eqNullSafe("ledger"))
    own = priced(own, rates) if rates is not None else own.withColumn("write_rate", F.lit(None).cast("double"))
    nxt = own.select("request_id", "pending", "context_tokens", "output_tokens", F.lead(F.struct("pending", "context_tokens", "write_rate", "cost_usd_micros")).over(party).alias("n"))
    moved = F.col("n.context_tokens") - F.col("context_tokens")
    growth = F.when((F.col("pending") == 1) | (F.col("n.pending") == 1) | (moved < -DROP), None).otherwise(F.greatest(moved - F.col("output_tokens"), F.lit(0)))
    growth = F.when(moved.isNull() | F.col("output_tokens").isNull(), None).otherwise(growth)
    grown = nxt.select("request_id", growth.alias("growth"), F.when(F.col("n.cost_usd_micros").isNotNull(), F.col("n.write_rate")).alias("rate"))
    of_request = Window.partitionBy("request_id")
    upto = of_request.orderBy("tool_use_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = calls.where("request_id is not null").select("tool_use_id", "request_id", "bytes_delivered")
    c = c.select("*", F.count("*").over(of_request).alias("n"), F.count("bytes_delivered").over(of_request).alias("known"), F.sum("bytes_delivered").over(of_request).alias("total"), F.sum("bytes_delivered").over(upto).alias("cum"))
    j = c.join(grown, "request_id")
    upper, lower = F.round(F.col("growth") * F.col("cum") / F.col("total")), F.round(F.col("growth") * (F.col("cum") - F.col("bytes_delivered")) / F.col("total"))
    tokens = F.when(F.col("n") == 1, F.col("growth")).when((F.col("known") == F.col("n")) & (F.col("total") > 0), (upper - lower).cast("long"))
    basis = F.when(tokens.isNotNull(), F.when(F.col("n") == 1, "exact").otherwise("split"))
    return j.select("tool_use_id", tokens.alias("result_tokens"), basis.alias("result_basis"), F.round(tokens * F.col("rate") * 1_000_000).cast("long").alias("result_write_micros"))
