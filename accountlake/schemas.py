"""Fixed schemas of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

from accountlake import vocab

LINKS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])
)
SIGNALS = T.StructType([T.StructField(name, T.BooleanType()) for name in vocab.SIGNAL_PATTERNS])

RAW_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("fetch_error", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

ANALYSIS = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("one_liner", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sells_to", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("business_model", T.StringType()),
    T.StructField("industries_served", T.ArrayType(T.StringType())),
    T.StructField("icp_fit_score", T.IntegerType()),
    T.StructField("icp_fit_rationale", T.StringType()),
    T.StructField("buying_signals", T.ArrayType(T.StringType())),
    T.StructField("disqualifiers", T.ArrayType(T.StringType())),
    T.StructField("primary_cta", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField(
        "evidence",
        T.ArrayType(
            T.StructType([T.StructField("claim", T.StringType()), T.StructField("quote", T.StringType())])
        ),
    ),
])

PROVENANCE = T.StructType([
    T.StructField("source_url", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("analyzed_at", T.TimestampType()),
    T.StructField("analyzer", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
])

CRM_EVENT = T.StructType([
    T.StructField("eventId", T.LongType()),
    T.StructField("objectId", T.LongType()),
    T.StructField("subscriptionType", T.StringType()),
    T.StructField("propertyName", T.StringType()),
    T.StructField("propertyValue", T.StringType()),
    T.StructField("occurredAt", T.TimestampType()),
    T.StructField("ingest_ts", T.TimestampType()),
])

RUN_LOG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("ran_at", T.TimestampType()),
    T.StructField("records", T.LongType()),
    T.StructField("recorded_at", T.TimestampType()),
])
