"""The keyword analyzer over pages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from accountlake import vocab
from accountlake.config import Profile
from accountlake.functions import scoring as S
from accountlake.functions.text import company_name, first_paragraph, normalise_text
from accountlake.schemas import ANALYSIS


def provenance(
    analyzer: Column,
    analyzed_at: datetime | None = None,
    input_tokens: Column | None = None,
    output_tokens: Column | None = None,
    cost: Column | None = None,
) -> Column:
    """Where a row's values came from; one analysis time per run."""
    def or_null(c: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if c is None else c.cast(kind)

    moment = analyzed_at or datetime.now(timezone.utc)
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.struct(
        F.col("final_url").alias("source_url"),
        F.col("fetched_at").cast("timestamp").alias("scraped_at"),
        F.lit(moment).alias("analyzed_at"),
        analyzer.alias("analyzer"),
        F.col("content_hash").alias("content_hash"),
        or_null(input_tokens, "long").alias("input_tokens"),
        or_null(output_tokens, "long").alias("output_tokens"),
        or_null(cost, "double").alias("cost_usd"),
    )


def analyse(
    pages: DataFrame,
    profile: Profile,
    *,
    analyzed_at: datetime | None = None,
    categories=None,
    verticals=vocab.VERTICALS,
    markers: dict | None = None,
    signal_notes=None,
) -> DataFrame:
    """Add ``analysis`` and ``provenance`` to pages with ``page_signals``.

    Three projections, so that the lower-cased copy and its normalised form are each
    made once and no single generated method holds all the string tests. ``markers``
    may replace the lists ``b2b, b2c, enterprise, smb, cart, services``.
    """
    m = {
        "b2b": vocab.B2B_MARKERS, "b2c": vocab.B2C_MARKERS, "enterprise": vocab.ENTERPRISE_MARKERS,
        "smb": vocab.SMB_MARKERS, "cart": vocab.CART_MARKERS, "services": vocab.SERVICES_MARKERS,
        **(markers or {}),
    }
    text = F.concat_ws(
        "\n", F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit("")), F.col("markdown")
    )
    staged = pages.withColumns({
        "_raw": F.lower(text),
        "_company": company_name("title", "domain"),
        "_paragraph": first_paragraph("markdown"),
    })
    staged = staged.withColumns({
        "_corpus": normalise_text("_raw"),
        "_category": S.category("_raw", categories),
        "_sells_to": S.sells_to("_raw", m["b2b"], m["b2c"]),
        "_segment": S.segment("_raw", m["enterprise"], m["smb"]),
        "_model": S.business_model("_raw", "page_signals", m["cart"], m["services"]),
        "_industries": S.industries("_raw", verticals, vocab.MAX_INDUSTRIES),
        "_signals": S.buying_signals("_raw", "page_signals", signal_notes, vocab.MAX_BUYING_SIGNALS),
    })
    good, poor, possible = S.good_and_poor("_corpus", profile)
    staged = staged.withColumns({"_good": good, "_poor": poor})
    fields = {
        "company_name": F.col("_company"),
        "one_liner": S.one_liner("meta_description", "_paragraph", "_company", vocab.MAX_QUOTE),
        "category": F.col("_category"),
        "sells_to": F.col("_sells_to"),
        "segment": F.col("_segment"),
        "business_model": F.col("_model"),
        "industries_served": F.col("_industries"),
        "icp_fit_score": S.fit_score("_good", "_poor", possible),
        "icp_fit_rationale": S.rationale("_good", "_poor"),
        "buying_signals": F.col("_signals"),
        "disqualifiers": S.disqualifiers("_poor", "markdown", vocab.MAX_DISQUALIFIERS, vocab.MAX_POOR_TERMS),
        "primary_cta": S.primary_cta("page_signals"),
        "confidence": S.confidence("markdown"),
        "evidence": S.evidence("meta_description", "_paragraph", vocab.MAX_EVIDENCE, vocab.MAX_QUOTE),
    }
    analysis = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in ANALYSIS])
    return staged.select(
        *pages.columns,
        analysis.alias("analysis"),
        provenance(F.lit(vocab.HEURISTIC_ANALYZER), analyzed_at).alias("provenance"),
    )
