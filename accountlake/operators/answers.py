"""Prompts out, model answers in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from accountlake import vocab
from accountlake.config import Profile
from accountlake.functions.text import strings, truncate
from accountlake.functions.usage import billed_tokens, cost_usd
from accountlake.operators.analysis import provenance
from accountlake.operators.keys import one_per_key
from accountlake.schemas import ANALYSIS


def system_prompt(profile: Profile) -> str:
    """The part that is the same for every page of a run."""
    return vocab.SYSTEM_PROMPT.format(icp_block=profile.prompt_block())


def user_prompt(signal_names: list[str], max_chars: int | None = None) -> Column:
    """The part about one page, from its columns; the page's text is cut where ``max_chars`` is given."""
    def or_none(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)"))

    lines = [
        F.concat(F.lit(f"{name}: "), F.col("page_signals")[name].cast("string"))
        for name in sorted(signal_names)
    ]
    vendors = F.array_join("tech_signals", ", ")
    values = {
        "domain": F.col("domain"),
        "final_url": F.col("final_url"),
        "title": or_none("title"),
        "meta_description": or_none("meta_description"),
        "tech_signals": F.when(vendors == "", "(none detected)").otherwise(vendors),
        "page_signals": F.concat_ws("\n", *lines),
        "markdown": truncate("markdown", max_chars),
    }
    parts: list[Column] = []
    for i, piece in enumerate(vocab.USER_PROMPT.split("{")):
        name, brace, text = piece.partition("}")
        if i and brace:
            parts += [values[name], F.lit(text)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def prompts(pages: DataFrame, profile: Profile, max_chars: int | None = None) -> DataFrame:
    """One request per page for any batch model run. ``max_chars`` keeps long pages inside a model's context."""
    names = pages.schema["page_signals"].dataType.names
    return pages.select(
        "domain", "content_hash",
        F.lit(system_prompt(profile)).alias("system"),
        user_prompt(names, max_chars).alias("user"),
    )


# --- answers ---------------------------------------------------------------

_REQUIRED = [f.name for f in ANALYSIS]
_LISTS = {
    "industries_served": vocab.MAX_INDUSTRIES,
    "buying_signals": vocab.MAX_BUYING_SIGNALS,
    "disqualifiers": vocab.MAX_DISQUALIFIERS,
    "evidence": vocab.MAX_EVIDENCE,
}
_ENUMS = {
    "sells_to": vocab.SELLS_TO,
    "segment": vocab.SEGMENTS,
    "business_model": vocab.BUSINESS_MODELS,
}
_RANGES = {"icp_fit_score": (0, 100), "confidence": (0.0, 1.0)}


def _part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _kind(v: Column) -> Column:
    """JSON type of a variant as Spark names it, e.g. ``STRING`` or ``VOID`` for null."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _items_are(v: Column, name: str, good: Callable[[Column], Column]) -> Column:
    """Whether a field is a list all of whose elements are good."""
    items = _part(v, name, "array<variant>")
    return _kind(_part(v, name)).startswith("ARRAY") & ~F.exists(items, lambda x: ~good(x))


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_evidence(v: Column) -> Column:
    """An object with a claim and a quote; other members are left alone."""
    members = [_is_text(_part(v, f.name)) for f in ANALYSIS["evidence"].dataType.elementType]
    return _kind(v).startswith("OBJECT") & members[0] & members[1]


def _is_number(v: Column, name: str, whole: bool) -> Column:
    """A number, or text of one; whole where the field counts."""
    value = _part(v, name, "double")
    number = value.isNotNull() & _kind(_part(v, name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)")
    return number & (value == F.floor(value)) if whole else number


def _well_typed(v: Column, field: T.StructField) -> Column:
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return _is_text(_part(v, field.name))
    if isinstance(kind, T.ArrayType):
        return _items_are(v, field.name, _is_text if isinstance(kind.elementType, T.StringType) else _is_evidence)
    return _is_number(v, field.name, isinstance(kind, T.IntegerType))


def _value(v: Column, field: T.StructField) -> Column:
    """A field in its type; counted numbers come as whole floats or text too."""
    if isinstance(field.dataType, T.IntegerType):
        return _part(v, field.name, "double").try_cast("int")
    return _part(v, field.name, field.dataType.simpleString())


def violations(v: Column, keys: Column) -> Column:
    """What is wrong with a parsed answer, as ``field: problem`` texts; empty when nothing is.

    Types are those of the JSON itself, of every list element and every member of the evidence.
    """
    def note(broken: Column, text: str) -> Column:
        return F.when(broken, F.lit(text))

    typed = {f.name: F.coalesce(_well_typed(v, f), F.lit(False)) for f in ANALYSIS}
    found = [note(~typed[name], f"{name}: missing or wrong type") for name in _REQUIRED]
    found += [
        note(typed[n] & ~_part(v, n, "string").isin(*allowed), f"{n}: not an allowed value") for n, allowed in _ENUMS.items()
    ]
    found += [
        note(typed[n] & ~_part(v, n, "double").between(low, high), f"{n}: out of range") for n, (low, high) in _RANGES.items()
    ]
    found += [note(typed[n] & (F.size(_part(v, n, "array<variant>")) > most), f"{n}: too many entries") for n, most in _LISTS.items()]
    extra = F.array_sort(F.array_except(keys, strings(_REQUIRED)))
    unknown = F.transform(extra, lambda k: F.concat(k, F.lit(": unknown field")))
    return F.concat(F.array_compact(F.array(*found)), F.coalesce(unknown, F.array().cast("array<string>")))


def validate_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Parse JSON answers; add ``analysis`` (null unless valid), ``valid`` and ``violations``."""
    v = F.col("_parsed")
    parsed = answers.withColumns({"_parsed": F.try_parse_json(answer), "_keys": F.json_object_keys(answer)})
    problems = F.when(
        ~_kind(v).startswith("OBJECT") | F.col("_keys").isNull(), F.array(F.lit("answer: not a JSON object"))
    ).otherwise(violations(v, F.col("_keys")))
    judged = parsed.withColumn("violations", problems)
    valid = F.size("violations") == 0
    analysis = F.struct(*[_value(v, f).alias(f.name) for f in ANALYSIS])
    return judged.withColumns({"valid": valid, "analysis": F.when(valid, analysis)}).drop("_parsed", "_keys")


def price(
    results: DataFrame, prices: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Add ``billed_input_tokens`` and ``cost_usd``; no price, no cost.

    The price list is configuration, so it becomes literals in the projection; no join.
    """
    billed = results.withColumn(
        "billed_input_tokens", billed_tokens("provider", "input_tokens", "cached_tokens")
    )
    return billed.withColumn("cost_usd", cost_usd("model", "billed_input_tokens", "output_tokens", prices))


def with_fallback(
    analysed: DataFrame,
    answers: DataFrame,
    *,
    analyzed_at: datetime | None = None,
    prices: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """The model's answer where it is valid, else the keyword analysis already there.

    ``answers``: by ``(domain, content_hash)``, with ``answer, provider, model, input_tokens, cached_tokens,
    output_tokens``; of several valid ones the smallest counts.
    """
    checked = price(validate_answers(answers), prices).where("valid").select(
        "domain", "content_hash",
        F.struct(
            "analysis", "provider", "model", "billed_input_tokens", "output_tokens", "cost_usd"
        ).alias("_a"),
    )
    checked = one_per_key(checked, ["domain", "content_hash"], ["_a"])
    a = F.col("_a")
    by_model = provenance(
        F.concat(a["provider"], F.lit(":"), a["model"]), analyzed_at,
        a["billed_input_tokens"], a["output_tokens"], a["cost_usd"],
    )
    joined = analysed.join(checked, ["domain", "content_hash"], "left")
    rest = [c for c in analysed.columns if c not in ("analysis", "provenance")]
    return joined.select(
        *rest,
        F.coalesce(a["analysis"], F.col("analysis")).alias("analysis"),
        F.when(a.isNotNull(), by_model).otherwise(F.col("provenance")).alias("provenance"),
    )
