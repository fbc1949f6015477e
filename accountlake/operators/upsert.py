"""What a write would do: find the record, compare, write only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from accountlake.functions.values import comparable
from accountlake.operators.keys import lookup_join, row_per_key
from accountlake.spark import stored

MAX_LABEL = 63


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _one_record_per_key(existing: DataFrame, key: Column) -> DataFrame:
    """The record with the smallest id for every key."""
    keyed = row_per_key(existing.withColumn("_key", key), ["_key"], ["record_id"])
    return keyed.select("_key", F.struct(*existing.columns).alias("_found"))


def _nowhere() -> Column:
    """A key that no record has, for failed payloads: they pass through the join without piling up on null."""
    return F.concat(F.lit("\x00"), F.spark_partition_id().cast("string"), F.lit(":"), F.col("domain"))


def find_by_key(payloads: DataFrame, existing: DataFrame, match_key: str) -> DataFrame:
    """Payloads with ``_found``: the existing record of the same key, or null."""
    found = _one_record_per_key(existing, _key(F.col(match_key)))
    key = F.coalesce(_key(F.col("match_value")), _nowhere())
    return payloads.withColumn("_key", key).join(found, "_key", "left").drop("_key")


def _label_keys(website: Column) -> Column:
    """Every way a searched domain could begin inside a website text.

    A domain found in a text has its first label at the end of one of the text's
    dot-separated pieces and, when it has three labels or more, its second label as
    the whole next piece. So the keys are the piece endings (up to 63 characters)
    alone, and together with the next piece: linear in the text, no pairs.
    """
    pieces = F.split(website, r"\.", -1)
    last = F.size(pieces) - 1

    def endings(piece: Column, i: Column) -> Column:
        n = F.least(F.length(piece), F.lit(MAX_LABEL))
        suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.right(piece, k)))
        following = F.when(i + 1 < last, F.get(pieces, i + 1))
        keys = F.transform(
            suffixes,
            lambda s: F.array_compact(F.array(F.concat(s, F.lit(".")), F.concat(s, F.lit("."), following, F.lit(".")))),
        )
        return F.when((i < last) & (n > 0), F.flatten(keys)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(pieces, endings)))


GRAM = 3


def _start_key(needle: Column) -> Column:
    """The key of a text without a dot: its first characters, marked off from labels."""
    return F.concat(F.lit("\x01"), F.left(needle, F.lit(GRAM)))


def _start_keys(website: Column) -> Column:
    """Every run of one to three characters inside a website text, as keys of ``_start_key``."""
    places = F.sequence(F.lit(1), F.greatest(F.length(website), F.lit(1)))

    def runs(n: int) -> Column:
        return F.transform(places, lambda i: F.concat(F.lit("\x01"), F.substring(website, i, F.lit(n))))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))


def _search_key(needle: Column) -> Column:
    """The key under which ``_label_keys`` lists every text that contains the needle."""
    pieces = F.split(needle, r"\.", -1)
    first = F.right(F.get(pieces, F.lit(0)), F.lit(MAX_LABEL))
    second = F.when(F.size(pieces) > 2, F.concat(F.get(pieces, F.lit(1)), F.lit("."))).otherwise("")
    return F.concat(first, F.lit("."), second)


FILTER_WORDS = 1 << 16  # 64-bit words of the filter of searched labels: half a megabyte, whatever is searched


def _bit(label: Column) -> tuple[Column, Column]:
    """Word and bit of a label in the filter."""
    at = F.pmod(F.xxhash64(label), F.lit(FILTER_WORDS * 64))
    return F.floor(at / 64).cast("int"), F.pmod(at, F.lit(64)).cast("int")


def _label_filter(labels: DataFrame) -> Column:
    """A Bloom filter of labels, one hash each, as a scalar subquery: an array of words of fixed size."""
    word, bit = _bit(F.col("_label"))
    bits = labels.select(word.alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("w")).groupBy("i").agg(
        F.bit_or("w").alias("w"))
    every = labels.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("i")).join(bits, "i", "left")
    words = F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    return every.agg(F.transform(words, lambda x: x["w"]).alias("f")).scalar()


def _may_be_searched(label: Column, words: Column) -> Column:
    word, bit = _bit(label)
    return F.getbit(F.get(words, word), bit) == 1


def find_by_contains(payloads: DataFrame, existing: DataFrame, match_key: str, **join) -> DataFrame:
    """Payloads with ``_found``: the smallest-id record whose key text contains the bare domain.

    An equality join on label keys finds the possible pairs, ``contains`` settles
    them; equal texts are reduced to one record first and hot keys are spread. Texts without a dot
    have no label to look up; they are searched by their first three characters (one or two
    by that many), which texts list only if there are such searches. What a text lists passes a
    filter of the searched labels before anything is shuffled. Both tables are read twice: to search, and for the result. Of records with one
    id and the same text the smallest counts.
    """
    needle = F.lower(F.btrim(F.regexp_replace(F.col("match_value"), "^.*//", ""), F.lit("/")))
    plain = ~F.col("_needle").contains(".")
    wanted = stored(
        payloads.select(needle.alias("_needle")).where("_needle <> ''").distinct().withColumn(
            "_label", F.when(plain, _start_key(F.col("_needle"))).otherwise(_search_key(F.col("_needle")))),
        "searched")
    labels = wanted.select("_label").distinct()
    any_plain = F.coalesce(wanted.agg(F.bool_or(plain).alias("p")).scalar(), F.lit(False))
    text = F.col("_text")
    listed = F.concat(_label_keys(text), F.when(any_plain, _start_keys(text)).otherwise(F.array().cast("array<string>")))
    texts = (
        existing.select(F.lower(F.col(match_key)).alias("_text"), "record_id")
        .where("_text is not null")
        .groupBy("_text").agg(F.min("record_id").alias("_id"))
        .select("_text", "_id", F.explode(listed).alias("_label"))
        .where(_may_be_searched(F.col("_label"), _label_filter(labels)))
    )
    texts = stored(texts.join(labels, "_label", "left_semi"), "listed")
    hits = (
        lookup_join(texts, wanted, ["_label"], how="inner", **join)
        .where(text.contains(F.col("_needle")))
        .groupBy("_needle").agg(F.min(F.struct("_id", "_text")).alias("_hit"))
        .select("_needle", "_hit.*")
    )
    records = existing.select(F.col("record_id").alias("_id"), F.lower(F.col(match_key)).alias("_text"), F.struct(*existing.columns).alias("_found"))
    found = hits.join(records, ["_id", "_text"]).groupBy("_needle").agg(F.min("_found").alias("_found"))
    return payloads.withColumn("_needle", F.coalesce(needle, _nowhere())).join(found, "_needle", "left").drop("_needle")


def upsert_plan(
    payloads: DataFrame,
    existing: DataFrame | None,
    *,
    destination: str,
    match_key: str,
    match: str = "key",
    dry_run: bool = False,
    **join,
) -> DataFrame:
    """``domain, destination, action, record_id, changed_fields, changes, error``.

    ``existing`` has ``record_id`` and the property columns, in any scalar type;
    without it every good payload would be created. ``changes`` is the JSON of the
    properties to write. ``match`` is ``key`` (equal keys) or ``contains``.
    """
    kinds = payloads.schema["properties"].dataType
    assert isinstance(kinds, T.StructType)
    if existing is None:
        found, old_kinds = payloads.withColumn("_found", F.lit(None).cast("struct<record_id:string>")), {}
    else:
        # only what is compared is read and shuffled, however wide the existing table is
        needed = {"record_id", match_key, *kinds.names}
        existing = existing.select(*[c for c in existing.columns if c in needed])
        finder = {"key": find_by_key, "contains": find_by_contains}[match]
        found = finder(payloads, existing, match_key, **join)
        old_kinds = {f.name: f.dataType for f in existing.schema}

    exists = F.col("_found").isNotNull()
    changed, values = [], []
    for name in sorted(kinds.names):
        new = F.col("properties")[name]
        old = F.lit("")
        if name in old_kinds:
            old = comparable(F.col("_found")[name], old_kinds[name])
        differs = new.isNotNull() & (~exists | (comparable(new, kinds[name].dataType) != old))
        changed.append(F.when(differs, F.lit(name)))
        values.append(F.when(differs, new).alias(name))
    compared = found.withColumn("_fields", F.array_compact(F.array(*changed)))
    dry = dry_run or existing is None
    action = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(~exists, "would_create" if dry else "created")
        .when(F.size("_fields") == 0, "skipped")
        .otherwise("would_update" if dry else "updated")
    )
    # Failed and good payloads stay in one plan: splitting them would run all that led here twice.
    return compared.select(
        "domain", F.lit(destination).alias("destination"), action.alias("action"),
        F.col("_found.record_id").cast("string").alias("record_id"),
        F.col("_fields").alias("changed_fields"),
        F.when(F.size("_fields") > 0, F.to_json(F.struct(*values))).alias("changes"),
        "error",
    )


def to_write(plan: DataFrame) -> DataFrame:
    """Only the rows that change something."""
    return plan.where(F.col("action").isin("created", "updated"))
