"""Near copies by the Jaccard likeness of sets of five-word shingles.

Texts with the same set of shingles are one set first, so copies cost nothing later. Sets that agree
in a band of MinHash values are candidates. Candidates' values are compared a few at a time; a pair
is dropped once the posterior probability that its likeness reaches the threshold is
below a tolerance. What remains forms loose groups; inside those all pairs of sets are
compared exactly, in blocks, by products of incidence matrices. No table of pairs is ever made: tasks give
one row per set with the number of its links and one edge to the smallest set it is linked with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlake.llm.common import packed, pick, saved, unpacked
from accountlake.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BAND, BANDS = 5, 32  # a pair at 0.8 shares no band with probability 3e-6
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-6  # posterior probability below which a pair is dropped
BUCKET_BLOCK = 4096  # members of a bucket in one task
EXACT_BLOCK = 512  # sets of a group compared in one task
EXACT_BYTES = 32 << 20  # and their shingles

_HASHES = BAND * BANDS
_RNG = np.random.default_rng(5)
_FLIP = _RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX32 = np.uint32(0x9E3779B1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)], dtype=np.uint64)
EMPTY = (0, 0)  # the id of the set without shingles


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of all words together if there are fewer.

    Words end at ASCII white space. Sets are compared by these hashes.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        runs = hashes[: n - WORDS + 1] * _WEIGHTS[0]
        for i in range(1, WORDS):
            runs += hashes[i : n - WORDS + 1 + i] * _WEIGHTS[i]
        runs = (runs ^ (runs >> np.uint64(31))) * _SPREAD
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def minhashes(found: np.ndarray) -> np.ndarray:
    """One byte of each of the 160 smallest values of a set that is not empty."""
    low = (found >> np.uint64(16)).astype(np.uint32)
    least = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for s in range(0, len(low), 2048):
            np.minimum(least, ((low[s : s + 2048, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
        least = (least ^ (least >> np.uint32(15))) * _MIX32
        return (least >> np.uint32(24)).astype(np.uint8)


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its five bytes."""
    part = values.reshape(BANDS, BAND).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)
    for i in range(BAND):
        key = (key << 8) | part[:, i]
    return key


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For every number of compared values, the fewest that must agree for a pair to go on.

    With a flat prior the likeness ``s`` after ``m`` agreeing values of ``n`` is a Beta(m + 1, n - m + 1)
    variable, and the probability that it is at least ``t`` is that of at most ``m`` successes
    in ``n + 1`` trials of probability ``t``. Values are bytes, which agree by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


_FEWEST = fewest_matches()


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Positions in ``many`` (rows of MinHash bytes) that are not dropped against ``one``."""
    at = np.arange(len(many))
    same = np.zeros(len(many), np.int64)
    for k, need in enumerate(_FEWEST):
        s = k * STEP
        same += (many[at, s : s + STEP] == one[s : s + STEP]).sum(axis=1)
        go = same >= need
        at, same = at[go], same[go]
        if not len(at):
            break
    return at


def _loose_edges(ids: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the surviving pairs of one bucket connect: a walk from the smallest id on."""
    out, left = [], np.arange(len(ids))
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = survivors(values[queue.pop()], values[left])
            if len(hit):
                out += [(int(ids[root]), int(ids[x])) for x in left[hit]]
                queue += left[hit].tolist()
                left = np.delete(left, hit)
    return out


def _groups(batches, keys: list[str]):
    """Arrow tables of rows that agree in ``keys``, from batches sorted by them. Small groups come many at a time.

    Yields ``(table, starts)``: every group but a batch's last is whole at once; the last waits for more.
    """
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            last = int(starts[-1])
            yield table.slice(0, last), np.concatenate(([0], starts[:-1], [last]))
            table = table.slice(last)
        held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _bucket_edges(batches):
    """Surviving pairs of each bucket (or pair of blocks of one) as connecting edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for table, starts in _groups(batches, ["band", "i", "j"]):
        ids = table.column("rep").to_numpy()
        values = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, _HASHES)
        size = np.diff(starts)
        out = []
        two = starts[:-1][size == 2]  # most buckets: both values compared for all such buckets at once
        if len(two):
            at, same = two, np.zeros(len(two), np.int64)
            for k, need in enumerate(_FEWEST):
                s = k * STEP
                same = same + (values[at, s : s + STEP] == values[at + 1, s : s + STEP]).sum(axis=1)
                at, same = at[same >= need], same[same >= need]
            out += zip(ids[at].tolist(), ids[at + 1].tolist(), strict=True)
        for a, b in zip(starts[:-1][size > 2], starts[1:][size > 2], strict=True):
            out += _loose_edges(ids[a:b], values[a:b])
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets: products of incidence matrices over their shared shingles."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(owner):
        return out
    first = np.ones(len(column), bool)
    first[1:] = column[1:] != column[:-1]
    column = np.cumsum(first) - 1
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], column[a:b] - k * width] = 1.0
            out += m @ m.T
    return out


def _verified(batches):
    """Exact likeness inside a group (or between two blocks of one): links of each set and one edge."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("whole", pa.bool_())])
    for table, starts in _groups(batches, ["grp", "i", "j"]):
        ids, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        blocks = table.column("blocks").to_numpy()
        raw = table.column("found")
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            me = ids[a:b]
            # A table with repeated rows may bring a set twice.
            once = np.sort(np.unique(me, return_index=True)[1])
            me, weight, side = me[once], copies[a:b][once], block[a:b][once]
            sets = [np.frombuffer(raw[int(a + x)].as_py(), np.uint64) for x in once]
            both = common_counts(sets)
            size = np.array([len(x) for x in sets], np.float64)
            union = size[:, None] + size[None, :] - both
            near = both >= THRESHOLD * union - 1e-9
            np.fill_diagonal(near, False)
            if i[a] != j[a]:
                near &= side[:, None] != side[None, :]
            links = near @ weight
            root = np.arange(len(me))
            while True:  # the smallest member reached, until nothing changes
                low = np.where(near, root[None, :], len(me)).min(axis=1, initial=len(me))
                new = np.minimum(root, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            out += zip(me.tolist(), links.tolist(), me[root].tolist(), [bool(blocks[a] == 1)] * len(me), strict=True)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
            )


def _signed(batches):
    """Each row with the id of its set of shingles, the set's size, MinHash bytes and band keys."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()),
        ("sig", pa.binary()), ("bands", pa.list_(pa.int64())),
    ])
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            if len(found):
                raw = found.tobytes()
                values = minhashes(found)
                digest = xxhash.xxh3_128_intdigest(raw)
                hi, lo = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
                out.append((hi, lo, len(found), values.tobytes(), bands(values).tolist()))
            else:
                out.append((*EMPTY, 0, b"", []))
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)


def _found(batches):
    for batch in batches:
        sets = pa.array([shingles(x).tobytes() for x in batch.column(0).to_pylist()], pa.binary())
        names = ["found", *batch.schema.names[1:]]
        yield pa.RecordBatch.from_arrays([sets, *batch.columns[1:]], names=names)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def _blocks(rows: DataFrame, count, of: str) -> DataFrame:
    """Members dealt to ``count`` blocks, and each repeated once for every pair of blocks it takes part in."""
    dealt = rows.withColumn("blocks", count).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.col(of)), F.col("blocks"))
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn(
        "j", F.greatest("block", "other")).drop("other")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``row_id``, ``doc_id``, ``text_key``, its class and its links.

    ``class_id`` is the smallest ``doc_id`` of the class (null only if all are null), ``n_links`` the other
    rows whose likeness to this one is at least 0.8, copies counted, ``class_size`` the rows of the class and
    ``stays`` marks one of them, of the smallest id. Texts without words, null ones too, are copies of
    each other. Rows may repeat. An empty table gives no rows. A pair at the threshold is lost with a
    probability of some 1e-5; every reported link is exact on 64-bit shingle hashes.
    """
    texts = _texts(docs)
    signed = texts.mapInArrow(
        _signed, "doc_id long, text_key long, hi long, lo long, n long, sig binary, bands array<long>"
    )
    rows = saved(signed.withColumn("row_id", F.monotonically_increasing_id()), "signed")
    sets = saved(rows.groupBy("hi", "lo").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    reps = rows.join(sets.select("rep", "copies"), F.col("row_id") == F.col("rep"))

    # Loose groups: sets that share a band and survive the comparison of values.
    banded = reps.select("rep", F.explode("bands").alias("band"))
    busy = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = saved(banded.join(busy, "band"), "banded").join(reps.select("rep", "sig"), "rep")
    dealt = _blocks(members, F.ceil(F.col("members") / BUCKET_BLOCK).cast("long"), "band")
    edges = (
        dealt.select("band", "i", "j", "rep", "sig").repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "rep").mapInArrow(_bucket_edges, "a long, b long")
    )
    loose = components(saved(edges.distinct(), "loose"))

    # Exact likeness inside them.
    kin = loose.select(F.col("id").alias("rep"), F.col("root").alias("grp")).join(
        reps.select("rep", "doc_id", "text_key", "n", "copies"), "rep")
    # Written before they are joined: with nothing but a shuffle on either side, the join may split a large group.
    sizes = saved(kin.groupBy("grp").agg(F.count(F.lit(1)).alias("g"), (F.sum("n") * 8).alias("bytes")), "sizes")
    kin = kin.join(sizes.select(
        "grp", F.greatest(F.ceil(F.col("g") / EXACT_BLOCK), F.ceil(F.col("bytes") / EXACT_BYTES)).cast("long").alias("b")
    ), "grp")
    kin = saved(kin.drop("n"), "kin")
    # Both sides grow with the corpus, so the join is a merge at every size.
    of_text = texts.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key").join(
        kin.hint("merge"), (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    ).select("text", "rep", "grp", "copies", "b")
    found = of_text.mapInArrow(_found, "found binary, rep long, grp long, copies long, b long")
    dealt = _blocks(found, F.col("b"), "grp").drop("b")
    exact = saved(
        dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep")
        .mapInArrow(_verified, "rep long, links long, a long, whole boolean"), "verified")
    # Groups of several blocks: the edges of their pairs of blocks are put together.
    parts = components(exact.where("not whole and a <> rep").select("a", F.col("rep").alias("b")))
    roots = exact.where("whole").select("rep", F.col("a").alias("root")).unionByName(
        parts.select(F.col("id").alias("rep"), "root"))
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    kinds = saved(
        sets.join(links, "rep", "left").join(roots, "rep", "left")
        .select("hi", "lo", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")),
        "kinds")
    named = rows.select("row_id", "doc_id", "text_key", "hi", "lo").join(kinds, ["hi", "lo"])
    named = saved(named, "named")
    classes = saved(named.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id")).alias("best"),
    ), "classes")
    return named.join(classes.hint("merge"), "root").select(
        "row_id", "doc_id", "text_key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size",
        (F.col("best.row_id") == F.col("row_id")).alias("stays"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of every class the one of the smallest ``doc_id``.

    Null ids come last, null texts are texts without words, of rows equal in id and text one stays; columns of any names are
    kept, an empty table stays empty.
    """
    stays = near_copies(docs).where("stays").select(
        F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_key").alias("k3"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = packed(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.col("doc_id").cast("long").isNull().alias("k2"),
        F.xxhash64(text).alias("k3"), "row")
    # Rows equal in id and text: one of them.
    keys = ["k1", "k2", "k3"]
    kept = whole.join(stays.hint("merge"), keys, "left_semi").withColumn(
        "_i", F.row_number().over(Window.partitionBy(*keys).orderBy("k3")))
    return unpacked(kept.where("_i = 1"), docs.columns)
