"""Log-bilinear language model, trained by noise-contrastive estimation, with corpus-wide word counts.

Tokens are lower-cased (A-Z) words, then one end per text. The model's units are the most frequent
words, the end, and classes of all other words by their last three bytes; a word of a class has
probability (count + 1) / (words of the class + distinct ones + 1) inside it, unseen words together
being one. Two context words give a vector by two matrices, and units are scored by its product with
theirs. Texts become units once, in a table. Tasks train on all positions of all training texts, in every
round, with shared noise words: equal positions of a task count once, by weight. Parameters are averaged
between rounds. Normalisers of all pairs of context units are batched
matrix products, done once, so the log-probability of a token is three table look-ups.

Counts cover every training token. Words too rare for the table that tasks hold are
looked up by a join; everything that is held or sent whole is bounded by a parameter.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import fold, pick, saved, shipped

WORDS = 700  # words that are units of their own
CLASSES = 320  # classes by ending
TABLE = 250_000  # words whose counts every task holds
SIZE = 24  # length of the vectors
NOISE = 64  # noise words, shared by a batch
BATCH = 320
HEAVY = 8  # a position that occurs more often is trained on in several steps
RATES = (0.15, 0.05)  # of the rounds
SHARD = 4_000_000  # positions a task trains on
PIECE = 20_000  # positions a row holds
FLUSH = 300_000  # distinct words a task counts before it sends them on
ENDING = 3


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary) and ``c``, summed in each task before the shuffle; the end is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def batch_of(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[b""] += 1
                if len(counts) > FLUSH:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Bounded tables every task holds. Units: words, then classes, the class of all other endings, the end."""

    table: dict[bytes, int]  # word -> position in the arrays below
    logs: np.ndarray  # log10(count + 1)
    units: np.ndarray
    inside: np.ndarray  # log10 of the probability inside the class, 0 for units of their own
    endings: dict[bytes, int]  # ending -> unit
    class_logs: np.ndarray  # unit -> log10 of what a class divides by
    unit_counts: np.ndarray
    train_tokens: int
    distinct: int
    ends: int

    @property
    def end(self) -> int:
        return len(self.unit_counts) - 1

    @property
    def other(self) -> int:
        return self.end - 1

    @property
    def contexts(self) -> int:
        """Units and the start of a text."""
        return self.end + 2

    @property
    def dtype(self) -> type:
        """What holds any unit: tables of units grow with them, not with the widest type."""
        return np.uint16 if self.contexts <= 1 << 16 else np.uint32


def vocabulary(counts: DataFrame, words: int = WORDS, classes: int = CLASSES, table: int = TABLE) -> tuple[Vocabulary, int]:
    """Units, classes and the table of frequent words; and the smallest count that table holds all words of."""
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))
    ).first()
    real = counts.where(F.length("word") > 0)
    # Steps of a tenth of an octave: a bounded histogram tells where the table must end.
    step = F.floor(F.log2("c") * 10).cast("int").alias("step")
    steps = sorted(real.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    held, least = 0, (steps[0]["least"] + 1 if steps else 1)
    for s in steps:
        held += s["n"]
        if held > table:
            break
        least = s["least"]
    top = real.orderBy(F.desc("c"), "word").limit(words)
    own = [(bytes(r["word"]), r["c"]) for r in top.collect()]
    rest = real.join(F.broadcast(counts.sparkSession.createDataFrame(own or [(b"", 0)], "word binary, c long").select("word")),
                     "word", "left_anti")
    endings = rest.groupBy(F.expr(f"substring(word, -{ENDING}, {ENDING})").alias("ending")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    endings = saved(endings, "endings")
    sums = endings.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = endings.orderBy(F.desc("c"), "ending").limit(classes).collect()
    other = sums[0] - sum(r["c"] for r in chosen), sums[1] - sum(r["n"] for r in chosen)
    k = len(own)
    ending_units = {bytes(r["ending"]): k + i for i, r in enumerate(chosen)}
    class_sizes = [(r["c"], r["n"]) for r in chosen] + [other]
    class_logs = np.array([0.0] * k + [math.log10(c + n + 1) for c, n in class_sizes] + [0.0])
    unit_counts = np.array([c for _, c in own] + [c for c, _ in class_sizes] + [total[2]], dtype=np.float64)
    frequent = dict(own)
    for r in real.where(F.col("c") >= least).collect():
        frequent[bytes(r["word"])] = r["c"]
    names = list(frequent)
    logs = np.log10(np.array([frequent[w] for w in names], dtype=np.float64) + 1.0) if names else np.zeros(0)
    place = {w: i for i, (w, _) in enumerate(own)}
    units = np.array([place.get(w, ending_units.get(w[-ENDING:], k + len(chosen))) for w in names], dtype=np.int32)
    inside = np.where(units < k, 0.0, logs - class_logs[units]) if names else np.zeros(0)
    vocab = Vocabulary({w: i for i, w in enumerate(names)}, logs, units, inside, ending_units, class_logs, unit_counts,
                       int(total[0]), int(total[1]), int(total[2]))
    return vocab, least


def _units(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Units of the words and the end, places in the table (-1: not in it), positions of those not in it."""
    at = np.fromiter(map(v.table.get, words, repeat(-1)), np.int32, len(words))
    rare = np.flatnonzero(at < 0).tolist()
    units = np.empty(len(words) + 1, np.int32)
    units[:-1] = v.units[at] if len(v.units) else v.other
    for i in rare:
        units[i] = v.endings.get(words[i][-ENDING:], v.other)
    units[-1] = v.end
    return units, at, rare


@dataclass
class Model:
    """Context vectors and matrices, unit vectors and biases. Context unit ``len(bias)`` is the start of a text."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    unit: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unit_counts: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        n = len(unit_counts)
        p = (unit_counts + 1) / (unit_counts + 1).sum()
        return cls(
            rng.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32), np.eye(SIZE, dtype=np.float32),
            np.eye(SIZE, dtype=np.float32) * np.float32(0.5), rng.normal(0, 0.1, (n, SIZE)).astype(np.float32),
            np.log(p).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.unit, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> Model:
        out, s = [], 0
        for x in self.arrays():
            out.append(flat[s : s + x.size].reshape(x.shape).astype(np.float32))
            s += x.size
        return Model(*out)


def _codes(units: np.ndarray, lengths: np.ndarray, contexts: int) -> np.ndarray:
    """Far, near and target unit of every position as one number; each piece of ``units`` begins with its two contexts."""
    kind = np.int32 if contexts**3 < 1 << 31 else np.int64  # up to two million units
    u = units.astype(kind)
    codes = (u[:-2] * kind(contexts) + u[1:-1]) * kind(contexts) + u[2:]
    ends = np.cumsum(lengths)[:-1]
    over = np.ones(len(codes), bool)  # positions whose contexts lie in the piece before
    over[ends - 1] = over[ends - 2] = False
    return codes[over]


def weighted(codes: np.ndarray, heavy: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions and how often they occur, in equal steps of at most ``heavy``."""
    found, n = np.unique(codes, return_counts=True)
    steps = -(-n // heavy)
    return np.repeat(found, steps), np.repeat((n / steps).astype(np.float32), steps)


def train(model: Model, codes: np.ndarray, weights: np.ndarray, noise: np.ndarray, rate: float = 0.1, seed: int = 0) -> Model:
    """One pass of noise-contrastive estimation over weighted positions, by Adagrad.

    Gradients are sums over a batch; squares start at 1, so that first steps are small.
    """
    rng = np.random.default_rng(seed)
    m = Model(*[x.copy() for x in model.arrays()])
    past = [np.ones(x.shape, np.float32) for x in m.arrays()]
    order = rng.permutation(len(codes))
    codes, weights = codes[order], weights[order]
    log_noise = (np.log(noise) + math.log(NOISE)).astype(np.float32)
    edges = np.cumsum(noise)
    contexts = len(m.context)
    cells = np.arange(contexts * SIZE).reshape(contexts, SIZE)

    def step(i, grad):
        x, g2 = m.arrays()[i], past[i]
        g2 += grad * grad
        grad *= rate
        grad /= np.sqrt(g2)
        x -= grad

    def summed(rows, grad, n):
        """Rows of ``grad`` added up by ``rows``, as one array of ``n`` rows."""
        total = np.bincount(cells.take(rows, 0).ravel(), grad.ravel(), n * SIZE)
        return total.reshape(n, SIZE).astype(np.float32)

    for s in range(0, len(codes), BATCH):
        pair, word = np.divmod(codes[s : s + BATCH], contexts)
        far, near = np.divmod(pair, contexts)
        w = weights[s : s + BATCH]
        drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE) * edges[-1]), len(edges) - 1)
        r_near, r_far = m.context.take(near, 0), m.context.take(far, 0)
        made = r_near @ m.near + r_far @ m.far
        u_word, u_drawn = m.unit.take(word, 0), m.unit.take(drawn, 0)
        real = np.einsum("ij,ij->i", made, u_word) + (m.bias - log_noise).take(word)
        fake = made @ u_drawn.T + (m.bias - log_noise).take(drawn)
        g_real = -w / (1 + np.exp(np.clip(real, -30, 30)))
        np.clip(fake, -30, 30, out=fake)
        np.exp(np.negative(fake, out=fake), out=fake)
        fake += 1
        g_fake = np.divide(w[:, None], fake, out=fake)
        g_made = g_real[:, None] * u_word + g_fake @ u_drawn
        g_unit = np.concatenate([g_real[:, None] * made, g_fake.T @ made])
        rows = np.concatenate([word, drawn])
        g_bias = np.bincount(rows, np.concatenate([g_real, g_fake.sum(0)]), len(m.bias)).astype(np.float32)
        g_context = np.concatenate([g_made @ m.near.T, g_made @ m.far.T])
        step(1, r_near.T @ g_made)
        step(2, r_far.T @ g_made)
        step(0, summed(np.concatenate([near, far]), g_context, contexts))
        step(3, summed(rows, g_unit, len(m.unit)))
        step(4, g_bias)
    return m


ENCODED = (
    "row_id long, doc_id long, units binary, places long, n_tokens long, known long, logs double, inside double, word binary, n long"
)


def encoded(texts: DataFrame, vocab) -> DataFrame:
    """The units of every text, up to ``PIECE`` a row behind the two before them, and its words that the table lacks.

    Rows with ``units`` (little-endian, ``vocab.dtype``) hold ``places`` positions; the first one of a text also its
    tokens, how many of them are known, the sum of their logs and of what the classes make of the model's score.
    Rows with ``word`` count one word whose count is not in the table; what its class divides by is in ``inside``.
    """
    names = [x.split()[0] for x in ENCODED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.binary(), pa.int64()]

    def run(batches):
        v = vocab()
        end_log = math.log10(v.ends + 1)
        start = np.full(2, v.end + 1, v.dtype)
        for batch in batches:
            rows = []
            for row_id, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = tokens(text)
                units, at, rare = _units(words, v)
                there = at[at >= 0]
                # Counts of rare words come by the join; what their class divides by is known here.
                inside = float(v.inside[there].sum()) - float(v.class_logs[units[rare]].sum())
                full = np.concatenate([start, units.astype(v.dtype)])
                facts = (len(units), len(there) + (v.ends > 0), float(v.logs[there].sum()) + end_log, inside)
                for s in range(2, len(full), PIECE):
                    piece = full[s - 2 : s + PIECE]
                    rows.append((row_id, doc_id, piece.tobytes(), len(piece) - 2, *facts, None, None))
                    facts = (None,) * 4
                rows += [(row_id, None, None, None, None, None, None, None, w, n) for w, n in Counter(words[i] for i in rare).items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select("row_id", "doc_id", "text").mapInArrow(run, ENCODED)


def _joined(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of a column of units as one array, and their lengths."""
    pieces = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(pieces), np.array([len(x) for x in pieces])


def _mean(parts: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weighted mean of parameter rows (``flat, n``), by a tree of at most 32 rows a task."""
    schema = pa.schema([("flat", pa.binary()), ("n", pa.float64())])

    def run(batches):
        total, n = None, 0.0
        for batch in batches:
            for flat, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(flat, np.float32).astype(np.float64) * w
                total, n = (x if total is None else total + x), n + w
        if total is not None:
            mean = (total / n).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([mean], pa.binary()), pa.array([n], pa.float64())], schema=schema)

    parts = saved(parts, "trained")
    count = parts.count()
    while count > 32:
        parts = saved(parts.repartition(math.ceil(count / 32)).mapInArrow(run, "flat binary, n double"), "trained")
        count = parts.count()
    rows = parts.collect()
    if not rows:
        return None
    n = sum(r["n"] for r in rows)
    return sum(np.frombuffer(r["flat"], np.float32).astype(np.float64) * r["n"] for r in rows) / n, n


def fitted(pieces: DataFrame, vocab, rates: tuple[float, ...] = RATES) -> Model:
    """The model after a round of local training and averaging per rate, over all positions of ``pieces`` (units, places)."""
    v = vocab()
    model = Model.start(v.unit_counts)
    noise = (v.unit_counts + 1) ** 0.75
    noise = noise / noise.sum()
    total = pieces.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    if not total:
        return model
    dealt = pieces.select("units").repartition(math.ceil(total / SHARD))
    for turn, rate in enumerate(rates):
        sent = shipped(pieces.sparkSession, model)

        def run(batches, sent=sent, turn=turn, rate=rate):
            v = vocab()
            rows = [_codes(*_joined(b.column(0), v.dtype), v.contexts) for b in batches if b.num_rows]
            if rows:
                n = sum(map(len, rows))
                got = train(sent(), *weighted(np.concatenate(rows)), noise, rate=rate, seed=turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([got.flat().tobytes()], pa.binary()), pa.array([float(n)], pa.float64())], names=["flat", "n"])

        mean = _mean(dealt.mapInArrow(run, "flat binary, n double"))
        if mean is not None:
            model = model.filled(mean[0])
    return model


def tables(spark, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of every near and far context with every unit, and the log-normaliser of every pair.

    ``log p(w | far, near) = near_table[near, w] + far_table[far, w] - normaliser[far, near]``, natural logs.
    The normalisers are batched matrix products, one far context a row, dealt over the cluster.
    """
    near = (model.context @ model.near @ model.unit.T + model.bias).astype(np.float32)
    far = (model.context @ model.far @ model.unit.T).astype(np.float32)
    sent = shipped(spark, model)

    def run(batches):
        m = sent()
        made = m.context @ m.near
        for batch in batches:
            for a in batch.column(0).to_pylist():
                scores = (made + m.context[a] @ m.far) @ m.unit.T + m.bias
                top = scores.max(axis=1)
                z = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a], pa.int64()), pa.array([z.astype(np.float32).tobytes()], pa.binary())], names=["far", "z"])

    n = len(model.context)
    rows = spark.range(n).repartition(max(1, n // 64)).mapInArrow(run, "far long, z binary").collect()
    z = np.stack([np.frombuffer(r["z"], np.float32) for r in sorted(rows, key=lambda r: r["far"])])
    return near, far, z


def _scored(vocab, sent):
    def run(batches):
        v = vocab()
        near, far, z = sent()
        for batch in batches:
            if not batch.num_rows:
                continue
            units, lengths = _joined(batch.column(1), v.dtype)
            at = units.astype(np.intp)
            a, b, u = at[:-2], at[1:-1], at[2:]
            logs = near[b, np.minimum(u, v.end)] + far[a, np.minimum(u, v.end)] - z[a, b]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for s in starts[1:]:  # what lies over the seam of two pieces is of neither
                logs[s - 2 : s] = 0
            sums = np.add.reduceat(logs.astype(np.float64), starts) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["row_id", "score"])

    return run


def scores(
    docs: DataFrame, rates: tuple[float, ...] = RATES, words: int = WORDS, classes: int = CLASSES, table: int = TABLE,
) -> DataFrame:
    """One row per row of ``docs``: held out or not, tokens, known ones, ``base_score`` and the model's ``score``.

    Trained on rows whose ``crc32(doc_id) % 7`` is not 2; a null id counts as the empty text. A null or empty
    text is one end. Without training rows every word falls into one class of unseen words. Repeated rows are scored
    and counted each; an empty table gives no rows; other columns, also ones that differ in case only, are not read.
    Long texts are cut into pieces of ``PIECE`` positions that know the two units before them. ``words`` and ``classes``
    are the model's units (their square bounds the table of normalisers), ``table`` the words whose counts tasks hold.
    """
    spark = docs.sparkSession
    texts = _texts(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    learnt = fold(F.col("doc_id"), 7) != 2
    counts = saved(word_counts(texts.where(learnt)), "counts")
    vocab, least = vocabulary(counts, words, classes, table)
    sent_vocab = shipped(spark, vocab)
    rows = saved(encoded(texts, sent_vocab), "units")
    pieces = rows.where("units is not null")
    sent_tables = shipped(spark, tables(spark, fitted(pieces.where(learnt), sent_vocab, rates)))
    scored = pieces.select("row_id", "units").mapInArrow(_scored(sent_vocab, sent_tables), "row_id long, score double")
    rare = rows.where("word is not null").select("row_id", "word", "n").join(
        counts.where((F.col("c") < least) & (F.length("word") > 0)), "word")
    rare_logs = F.col("n") * F.log10(F.col("c") + 1.0)
    # Everything known of a text, in parts: sums of them are combined before the one shuffle by row.
    parts = ("n_tokens", "known", "logs", "score")
    facts = pieces.where("n_tokens is not null").select(
        "row_id", "doc_id", "n_tokens", "known", "logs", F.col("inside").alias("score"))
    parted = facts.unionByName(scored, allowMissingColumns=True).unionByName(
        rare.select("row_id", F.col("n").alias("known"), rare_logs.alias("logs"), rare_logs.alias("score")),
        allowMissingColumns=True)
    whole = parted.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in parts])
    each = math.log10(vocab.train_tokens + vocab.distinct + 1)
    return whole.select(
        "doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(vocab.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )
