"""Toxicity scores: boosted trees over dense features of a text, calibrated to probabilities.

Features are densities of two lexicons, how near their words stand to a second person, capitals,
punctuation and obfuscation. One lexicon is fixed; the other holds the words that labels single out. Lexicon,
trees and the isotonic calibration are fitted by Spark on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import fold, packed, pick, saved, unpacked

# Fixed word lists: insults, second persons.
INSULTS = frozenset("""
idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile scum scumbag trash garbage pathetic
worthless loser losers clown clowns disgusting filthy pig fool ugly hate freak creep jerk bastard bitch ass
asshole shit shitty bullshit crap fuck fucking fucker damn whore slut retard retarded cretin vermin parasite
disgrace
idiota estupido estúpido imbécil basura asqueroso payaso inútil perdedor mierda puta
idiote stupide crétin connard connasse salaud ordure dégoûtant nul merde pute
dumm dummkopf trottel abschaum arschloch scheiße scheisse ekelhaft wertlos verlierer
""".split())
SECOND = frozenset("""
you your yours yourself yourselves u ur youre
tú usted ustedes vosotros vos tu tus
toi vous votre vos
du dich dir dein deine deinen euch ihr
""".split())

NEAR = 5  # words between an insult and a second person that count as near
FEATURES = (
    "learned", "learned_per_100", "distinct_learned", "insults", "insults_per_100", "distinct_insults", "second_per_100", "near_share", "nearness", "capitals",
    "capital_words", "punctuation", "exclamations", "symbols", "repeats", "obfuscated_per_100", "log_words",
)
SAMPLE = 20_000  # labelled rows used for fitting, at most
THRESHOLD = 0.7
LEAST_DOCS, LEAST_SHARE, LEAST_EVIDENCE = 4, 0.6, 20.0  # toxic texts with the word, their share, log-likelihood ratio

_WORDS = re.compile(r"\w+")
_TOKENS = re.compile(r"\S+")
# A sign or digit inside a word.
_HIDDEN = re.compile(r"\w[0-9@$!*.+|_-]+\w")
_LETTER = re.compile("[A-Za-z]")
_REPEAT = re.compile(r"(.)\1{2,}", re.DOTALL)
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i",
                        "*": "", ".": "", "-": "", "_": "", "+": ""})
_VOWELS = re.compile("[aeiou]")
_BARE = {_VOWELS.sub("", w): w for w in INSULTS if len(_VOWELS.sub("", w)) >= 3}


def _uncovered(token: str) -> bool:
    """Whether a disguised token is an insult once signs are read as letters or dropped."""
    word = token.lower().strip(".,;:!?\"'()")
    if word in INSULTS or not word:
        return False
    plain = word.translate(_SIGNS)
    return plain in INSULTS or "*" in word and _BARE.get(_VOWELS.sub("", plain)) is not None


def features(text: str, learned: frozenset[str] = frozenset()) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``; all 0 for the empty text."""
    words = _WORDS.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in INSULTS or w in learned]
    taught = [words[i] for i in hits if words[i] in learned]
    plain = [words[i] for i in hits if words[i] in INSULTS]
    seconds = [i for i, w in enumerate(words) if w in SECOND]
    per = 100.0 / n
    near, nearness = 0, 0.0
    at = 0
    for i in hits if seconds else ():
        while at + 1 < len(seconds) and abs(seconds[at + 1] - i) <= abs(seconds[at] - i):
            at += 1
        d = abs(seconds[at] - i)
        near += d <= NEAR
        nearness = max(nearness, 1.0 / max(d, 1))
    hidden = 0
    if _HIDDEN.search(text):
        hidden = sum(_uncovered(t) for t in text.split() if _HIDDEN.search(t) and _LETTER.search(t))
    size = len(text)
    capitals = 0 if text.islower() else sum(map(str.isupper, text))
    signs = sum(map(text.count, ".,;:!?"))
    return [
        float(len(taught)), len(taught) * per, float(len(set(taught))),
        float(len(plain) + hidden), (len(plain) + hidden) * per, float(len(set(plain))),
        len(seconds) * per, near / len(hits) if hits else 0.0, nearness,
        capitals / size, sum(w.isupper() and len(w) > 1 for w in text.split()) / n, signs / size, text.count("!") * per,
        sum(map(text.count, "#$%&*@^~")) / size, sum(1 for _ in _REPEAT.finditer(text)) * per, hidden * per,
        float(n.bit_length()),
    ]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _likeness_keys(words: list[str]) -> list[int]:
    """Three keys of a text: pairs of three smallest hashes of five words in a row. Near copies mostly share one."""
    runs = [" ".join(words[i : i + 5]).encode() for i in range(max(1, len(words) - 4))]
    least = [min(zlib.crc32(x, seed) for x in runs) for seed in (1, 2, 3)]
    return [(least[a] << 32 | least[b]) - (1 << 63) ^ c for c, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))]


def _evidence(pos, neg, all_pos, all_neg):
    """Log-likelihood ratio of a word's counts in toxic and clean texts against one common rate."""
    def part(x, rate):
        return F.when(x > 0, x * F.log(x / rate)).otherwise(0.0)

    total = all_pos + all_neg
    seen = pos + neg
    return 2 * (part(pos, seen * all_pos / total) + part(neg, seen * all_neg / total))


def learned_words(sample: DataFrame, lexicon: int | None = None) -> list[frozenset[str]]:
    """Words that toxic texts have far more often than clean ones: of fold 0, of fold 1, of both.

    All words with enough evidence; the ``lexicon`` strongest where that is given. Of near copies one text counts, else the
    words of a text that was copied would all stand out.
    """
    def run(batches):
        for batch in batches:
            keys, words = [], []
            for text in batch.column(3).to_pylist():
                found = _WORDS.findall(text.lower())
                keys.append(_likeness_keys(found))
                words.append(list(set(found)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))],
                names=["fold", "label", "hash", "keys", "words"])

    # Equal texts are one; of texts that share a key the one with the smallest hash teaches.
    kind = "fold int, label double, hash long, keys array<long>, words array<string>"
    single = sample.groupBy("label", "text").agg(F.min("fold").alias("fold")).select(
        "fold", "label", F.xxhash64("text").alias("hash"), "text")
    texts = saved(single.mapInArrow(run, kind), "toxic-words")
    keyed = texts.select("label", "hash", F.explode("keys").alias("key"))
    least = keyed.groupBy("label", "key").agg(F.min("hash").alias("least"))
    copies = keyed.join(least, ["label", "key"]).where("hash > least").select("label", "hash").distinct()
    texts = saved(texts.join(copies, ["label", "hash"], "left_anti"), "toxic-texts")
    toxic = F.col("label") == 1
    counts = texts.select("fold", "label", F.explode("words").alias("word")).groupBy("word").agg(*[
        F.count_if((F.col("fold") == f) & (toxic if y else ~toxic)).cast("double").alias(f"c{f}{y}") for f in (0, 1) for y in (0, 1)
    ])
    totals = {(r["fold"], int(r["label"])): float(r["n"]) for r in texts.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = saved(counts.where(F.col("c01") + F.col("c11") >= LEAST_DOCS), "toxic-counts")
    out = []
    for folds in ((0,), (1,), (0, 1)):
        pos, neg = (sum((F.col(f"c{f}{y}") for f in folds), F.lit(0.0)) for y in (1, 0))
        all_pos, all_neg = (sum(totals.get((f, y), 0.0) for f in folds) for y in (1, 0))
        if not all_pos or not all_neg:
            out.append(frozenset())
            continue
        strong = counts.select("word", pos.alias("pos"), neg.alias("neg")).withColumn(
            "llr", _evidence(F.col("pos"), F.col("neg"), F.lit(all_pos), F.lit(all_neg))
        ).where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") >= LEAST_SHARE * (F.col("pos") + F.col("neg"))) & (F.col("llr") >= LEAST_EVIDENCE))
        strong = strong if lexicon is None else strong.orderBy(F.desc("llr"), "word").limit(lexicon)
        out.append(frozenset(r["word"] for r in strong.select("word").collect()))
    return out


class Scorer:
    """The learned lexicon, fitted trees and calibration.

    Where too few labels leave something out, the rest stands: trees without calibration give their own probability, and
    without trees (labels of one class) the density of insults counts.
    """

    def __init__(self, learned: frozenset[str] = frozenset(), trees=None, calibration=None):
        self.learned, self.trees, self.calibration = learned, trees, calibration

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``features``) and a ``score`` from 0 to 1.

        Without a model the score is ``h / (h + 1)`` for ``h`` insults in 100 words.
        """
        if self.trees is None:
            h = F.col("features")[FEATURES.index("insults_per_100")]
            return rows.withColumn("score", h / (h + 1.0))
        keep = rows.columns
        guess = self.trees.transform(rows.withColumn("_x", array_to_vector("features"))).withColumn(
            "_p", vector_to_array("probability")[1]
        )
        if self.calibration is None:
            return guess.select(*keep, F.col("_p").alias("score"))
        return self.calibration.transform(guess.select(*keep, "_p")).withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))
        ).drop("_p", "_score")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 3, seed: int = 7, lexicon: int | None = None,
) -> Scorer:
    """Fit on labelled rows whose ``crc32(doc_id) % 3`` is not 1.

    About ``sample`` documents are used, chosen by a hash of their id: all where there are fewer. Three
    quarters go to the trees, in two folds; a row's learned lexicon is that of the other fold, so no row is
    described by words its own label chose. The rest fits the calibration, with the lexicon of both folds,
    as texts are scored; where it has one class only, there is no calibration, and where the trees' part has, the trees take all rows.
    Null labels are not used. A document labelled both ways counts once for each; of documents with one id the smallest text hash counts.
    """
    marks = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("label"))
    marks = marks.where(fold(F.col("_id"), 3) != 1).distinct()
    total = marks.select("_id").distinct().count()
    if total > sample:  # two rows an id at most: what is sent to the texts is bounded
        marks = marks.where(F.xxhash64("_id", F.lit(seed)) < (1 << 64) * sample // total - (1 << 63))
    part = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(8)).cast("int")
    marks = marks.withColumn("fold", F.when(part < 3, 0).when(part < 6, 1).otherwise(2))
    # The sample of labels is bounded, so it is sent to the texts; no text but the sample's is kept.
    texts = _texts(docs)
    joined = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("_id"))
    train = joined.groupBy("_id", "label", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    train = saved(train.select("fold", "label", "text"), "toxic-train")
    learned = learned_words(train.where("fold < 2"), lexicon)

    def run(batches):
        for batch in batches:
            folds, labels_, rows = (batch.column(i).to_pylist() for i in range(3))
            # Fold 0 is described by the words of fold 1, fold 1 by those of fold 0, the rest by those of both.
            marked = [features(x, learned[(1, 0, 2)[f]]) for f, x in zip(folds, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f == 2 for f in folds], pa.bool_()), pa.array(labels_, pa.float64()), pa.array(marked, pa.list_(pa.float64()))],
                names=["held", "label", "features"])

    described = train.select("fold", "label", "text").mapInArrow(run, "held boolean, label double, features array<double>")
    # A bounded table of a few megabytes, which the trees read again and again: few tasks, in a fixed order.
    rows = saved(described, "toxic-sample").coalesce(4).sortWithinPartitions("label", "features")
    rows = rows.select(array_to_vector("features").alias("x"), "label", "held")
    classes = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if len({y for _, y in classes}) < 2:
        return Scorer()
    apart = len({y for held, y in classes if not held}) == 2  # else the trees need the rows of the calibration
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(
        rows.where("not held") if apart else rows)
    calibration = None
    if apart and len({y for held, y in classes if held}) == 2:
        held = model.transform(rows.where("held")).select(vector_to_array("probability")[1].alias("_p"), "label")
        calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_score").fit(held)
    return Scorer(learned[2], model.setFeaturesCol("_x").setPredictionCol("_class"), calibration)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 at the threshold or above) of every whole text.

    One row per row of ``docs``, repeated ones too; null and empty texts are scored as texts without words; a null id is
    never labelled and counts as the empty text for ``held_out``. An empty table gives no rows. Whole texts are read, in proportion
    to their length, spaces or not; other columns, also ones that differ in case only, are not read.
    """
    scorer = fit(docs, labels)
    learned = scorer.learned

    def run(batches):
        for batch in batches:
            marks = [features(x, learned) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.list_(pa.float64()))], names=["doc_id", "features"])

    scored = scorer.score(_texts(docs).mapInArrow(run, "doc_id long, features array<double>"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold.

    Scores are a function of the text, so a row is scored where it stands: no join back. Repeated rows, null ids and columns
    of any names are kept as they are; an empty table stays empty.
    """
    scorer = fit(docs, labels)
    learned = scorer.learned
    whole = packed(docs, "doc_id", "text").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "row")
    target = f"features array<double>, row {whole.schema['row'].dataType.simpleString()}"

    def run(batches):
        for batch in batches:
            marks = [features(x, learned) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.list_(pa.float64())), batch.column(1)], names=["features", "row"])

    scored = scorer.score(whole.mapInArrow(run, target))
    return unpacked(scored.where(F.col("score") < threshold), docs.columns)
