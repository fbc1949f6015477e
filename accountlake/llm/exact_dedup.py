"""Exact copies by an extendible-hash index on shared files.

A text's key is a 64-bit hash. Tasks first combine what they read themselves: one entry per distinct
text, with the texts compared byte by byte, so a text with very many copies sends at most one entry
per task. The entries are files in the shared folder. The directory maps key prefixes to buckets: it
doubles, one more bit at a time, and splits the buckets that hold more than their capacity.
Owner tasks each process the key ranges of their buckets in order of key, chain the entries
of equal keys and compare their bytes again, so a hash collision never joins two texts.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlake.llm.common import packed, pick, ranked, saved, unpacked

CAPACITY = 32 << 20  # bytes of text in a bucket before it is split
LOCAL_BYTES = 16 << 20  # text a task holds while it combines its own rows
LOCAL_ROWS = 200_000  # rows a task holds while it combines

ENTRY = "kind int, entry long, key long, doc_id long, first boolean, bytes long, copies long, text_sha256 string"
FOUND = "entry long, bucket long, key long, chain int, keep_id long, group_size long, wins boolean, text_sha256 string"


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets of an extendible-hash directory over ``key, bytes``, and its depth in bits.

    One row per prefix of that depth: ``prefix, bucket, depth``. A bucket is the shortest prefix whose rows
    fit the capacity; several directory entries may share it. Two levels beyond the mean allow for uneven keys.
    """
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = max(0, math.ceil(math.log2(max(1, total / capacity))) + 2) if total > capacity else 0
    fine = keys.groupBy(prefix(F.col("key"), depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    table = fine.withColumn("depth", F.lit(0 if total <= capacity else None).cast("int"))
    for bits in range(1, depth + 1):  # the directory doubles
        held = F.sum("bytes").over(Window.partitionBy(F.shiftright("prefix", depth - bits)))
        fits = (held <= capacity) | F.lit(bits == depth)
        table = table.withColumn("depth", F.coalesce("depth", F.when(fits, bits)))
    # A bucket is named by its depth and prefix: a one, then the bits.
    bucket = F.expr(f"shiftright(prefix + shiftleft(1L, {depth}), {depth} - depth)")
    return saved(table.select("prefix", bucket.alias("bucket"), "depth"), "directory"), depth


def prefix(key, depth: int):
    """The first ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def _before(a, b) -> bool:
    """Whether id ``a`` is smaller than ``b``; null is the smallest."""
    return b is not None and (a is None or a < b)


def _combiner(text_field: int):
    names = [x.split()[0] for x in ENTRY.split(", ")] + ["row"]
    types = [
        pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(),
    ]

    def emit(entries, members, rows, part, serial):
        """Member rows, then one entry per text with the row that stays among those combined."""
        n = len(members)
        wins = {e[3] for e in entries}
        out = [(0, (part << 33) + serial + e, k, d, i in wins, None, None, None) for i, (e, k, d) in enumerate(members)]
        out += [
            (1, (part << 33) + serial + i, e[1], e[2], None, len(e[0]), e[4], hashlib.sha256(e[0]).hexdigest())
            for i, e in enumerate(entries)
        ]
        where = [e[5] for e in entries]  # (batch, position) of each entry's row
        kept = [rows[b].slice(i, 1) for b, i in where]
        column = pa.concat_arrays([pa.nulls(n, rows[0].type), *kept])
        flat = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        whole = pa.RecordBatch.from_arrays([*flat, column], names=names)
        for s in range(0, whole.num_rows, 2000):
            yield whole.slice(s, 2000)

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        entries, members, rows, chains, held = [], [], [], {}, 0
        for batch in batches:
            rows.append(batch.column(2))
            texts = batch.column(2).field(text_field)
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (key, doc_id, text) in enumerate(zip(keys, ids, texts, strict=True)):
                data = (text.as_py() or "").encode()
                chain = chains.setdefault(key, [])
                at = next((e for e in chain if entries[e][0] == data), None)
                if at is None:
                    at = len(entries)
                    chain.append(at)
                    # text, key, largest id, its member, copies, its row
                    entries.append([data, key, doc_id, len(members), 1, (len(rows) - 1, i)])
                    held += len(data)
                else:
                    e = entries[at]
                    e[4] += 1
                    if _before(e[2], doc_id):
                        e[2], e[3], e[5] = doc_id, len(members), (len(rows) - 1, i)
                members.append((at, key, doc_id))
            if held > LOCAL_BYTES or len(members) > LOCAL_ROWS:
                yield from emit(entries, members, rows, part, serial)
                serial += len(entries)
                entries, members, rows, chains, held = [], [], [], {}, 0
        if members:
            yield from emit(entries, members, rows, part, serial)

    return run


def _owner(text_field: int, with_rows: bool):
    names = [x.split()[0] for x in FOUND.split(", ")] + ["row"] * with_rows
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def finish(chain):
        out, rows = [], []
        for number, (_, found, best, row) in enumerate(chain):
            size = sum(c for _, _, _, c, _ in found)
            for entry, bucket, key, _, sha in found:
                out.append((entry, bucket, key, number, best[0], size, entry == best[1], sha))
                rows.append(row if entry == best[1] else None)
        return out, rows

    def batch_of(out, rows):
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        if with_rows:
            kind = next(r.type for r in rows if r is not None)
            columns.append(pa.concat_arrays([pa.nulls(1, kind) if r is None else r for r in rows]))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        current, chain = None, []  # the entries of one key, told apart by their bytes
        out, rows, held = [], [], 0
        for batch in batches:
            row = batch.column(batch.schema.names.index("row"))
            texts = row.field(text_field)
            narrow = batch.select(["bucket", "key", "entry", "doc_id", "copies", "text_sha256"]).to_pylist()
            for i, r in enumerate(narrow):
                if r["key"] != current:
                    o, w = finish(chain)
                    out += o
                    rows += w
                    current, chain = r["key"], []
                    if len(out) >= 1000 or held > LOCAL_BYTES:
                        yield batch_of(out, rows)
                        out, rows, held = [], [], 0
                data = (texts[i].as_py() or "").encode()
                held += len(data)
                mine = next((c for c in chain if c[0] == data), None)
                if mine is None:
                    mine = [data, [], (r["doc_id"], r["entry"]), None]
                    chain.append(mine)
                    better = True
                else:
                    best = mine[2]
                    better = _before(best[0], r["doc_id"]) or best[0] == r["doc_id"] and r["entry"] < best[1]
                if better:
                    mine[2] = (r["doc_id"], r["entry"])
                    if with_rows:  # a copy, so that the batch can go
                        mine[3] = pa.concat_arrays([row.slice(i, 1), row.slice(0, 0)])
                mine[1].append((r["entry"], r["bucket"], r["key"], r["copies"], r["text_sha256"]))
        o, w = finish(chain)
        out += o
        rows += w
        if out:
            yield batch_of(out, rows)

    return run


def _index(rows: DataFrame, text_field: int, capacity: int, with_rows: bool) -> tuple[DataFrame, DataFrame]:
    """Entries (files in the shared folder) and what the owners found, from ``key, doc_id, row``."""
    ddl = rows.schema["row"].dataType.simpleString()
    entries = saved(rows.mapInArrow(_combiner(text_field), f"{ENTRY}, row {ddl}"), "entries")
    texts = entries.where("kind = 1")
    buckets, depth = directory(texts.select("key", "bytes"), capacity)
    # One owner task per bucket, whatever the session's number of shuffle partitions: no two buckets meet in a task.
    named = saved(ranked(buckets.select("bucket").distinct(), [F.col("bucket")], "owner"), "owners")
    owners = max(1, named.count())
    buckets = saved(buckets.join(named, "bucket"), "owned")
    dealt = (
        texts.withColumn("prefix", prefix(F.col("key"), depth)).join(buckets, "prefix")
        .select("owner", "bucket", "key", "entry", "doc_id", "copies", "text_sha256", "row")
        .repartitionById(owners, F.col("owner").cast("int")).drop("owner").sortWithinPartitions("bucket", "key", "entry")
    )
    found = dealt.mapInArrow(_owner(text_field, with_rows), FOUND + (f", row {ddl}" if with_rows else ""))
    return entries, found


def exact_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Null counts as the empty text. The row with the largest ``doc_id`` stays (null is the smallest; of
    rows equal in id and text, one). An empty table gives no rows. Whole texts are compared.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(text.alias("text")).alias("row")
    )
    entries, found = _index(rows, 0, capacity, with_rows=False)
    members = entries.where("kind = 0").select("entry", "doc_id", "first")
    return members.join(found, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("wins") & F.col("first")).alias("kept"), "text_sha256", "bucket", "chain"
    )


def without_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows travel with their entries: there is no join back.

    Null texts count as empty, null ids are the smallest, of rows equal in id and text one stays; an empty table stays empty; columns
    of any names are kept. Texts of any length are compared whole.
    """
    at = docs.columns.index("text")
    rows = packed(docs, "doc_id", "text").select(
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), "row",
    )
    _, found = _index(rows, at, capacity, with_rows=True)
    return unpacked(found.where("wins"), docs.columns)


COPIES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""
