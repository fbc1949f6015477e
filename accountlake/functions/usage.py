"""Model usage, cost and display strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from accountlake import vocab
from accountlake.functions.text import col

# Vendors that count cached tokens inside the input figure.
CACHED_INSIDE_INPUT = ("openai",)


def billed_tokens(
    provider: Column | str,
    input_tokens: Column | str,
    cached_tokens: Column | str,
    cached_inside: Sequence[str] = CACHED_INSIDE_INPUT,
) -> Column:
    """All input tokens read, cache hits included."""
    total = F.coalesce(col(input_tokens), F.lit(0))
    cached = F.coalesce(col(cached_tokens), F.lit(0))
    fresh = F.when(col(provider).isin(*cached_inside), F.greatest(total - cached, F.lit(0))).otherwise(total)
    return fresh + cached


def cost_usd(
    model: Column | str,
    input_tokens: Column | str,
    output_tokens: Column | str,
    prices: Mapping[str, tuple[float, float]] | None = None,
) -> Column:
    """List price of a call; null for a model that is not in the price list."""
    prices = vocab.MODEL_PRICES if prices is None else prices
    cost = F.lit(None).cast("double")
    for name, (rate_in, rate_out) in prices.items():
        paid = col(input_tokens) / F.lit(1e6) * F.lit(rate_in) + col(output_tokens) / F.lit(1e6) * F.lit(rate_out)
        cost = F.when(col(model) == name, paid).otherwise(cost)
    return cost


def score_band(score: Column | str) -> Column:
    return F.when(col(score) >= 70, "green").when(col(score) >= 45, "yellow").otherwise("red")


def summary_line(domain: Column | str, ok: Column | str, error: Column | str, analysis: Column | str) -> Column:
    a = col(analysis)
    good = F.concat(
        col(domain), F.lit(": "), a["company_name"], F.lit(" — "), a["category"],
        F.lit(" — ICP "), a["icp_fit_score"].cast("string"),
    )
    failed = F.concat(col(domain), F.lit(": FAILED ("), F.coalesce(col(error), F.lit("None")), F.lit(")"))
    return F.when(col(ok) & a.isNotNull(), good).otherwise(failed)
