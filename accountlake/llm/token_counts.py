"""Token counts of whole texts under a public tokenizer file.

Texts are cut before spaces and line breaks that follow a character which is no white space, where the file's own rules
cannot join what lies on both sides: the counts of the pieces then add up, and no text is too long. The distinct
pieces a task has not met yet go to the library's batch encoding, in batches of about equal bytes; only lengths are kept.
A file whose rules do not allow such cuts gets whole texts, in batches of about equal bytes too.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import pick

BATCH_BYTES = 1 << 18  # text handed to the tokenizer at a time
KNOWN_BYTES = 1 << 26  # pieces a task remembers, in characters, before it starts anew
LIMIT = 1024

# A cut lies between a character that is not white space and one of these.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
# A plain split at spaces would cut behind white space if one of these occurs.
_DOUBLE = tuple(c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_UNSAFE = re.compile(r"\s ")


def _cuts_are_safe(rules: dict) -> bool:
    """Whether the rules of a tokenizer file keep what lies before a space or line break apart from what follows.

    Byte-level splitting does, and so does dropping white space between words; a special token must not hold or take spaces.
    """
    plain = {"NFC", "NFKC", "Lowercase"}

    def steps(part, inner):
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    def normal(step):
        # Runs of white space become one space: the words beside them stay what they are.
        squeezed = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        return step["type"] in plain or squeezed

    def split(step):
        if step["type"] == "ByteLevel":
            return not step["add_prefix_space"]
        # Words are what a pattern without white space matches.
        words = step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"]
        return words and not re.search(r"[ .]|\\[sSWD]", step["pattern"].get("Regex", " ").replace(r"[^\s", "["))

    parts = steps(rules["pre_tokenizer"], "pretokenizers")
    tokens = [t for t in rules["added_tokens"] if t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
    byte_level = any(s["type"] == "ByteLevel" and s.get("use_regex", True) for s in parts)
    removed = any(s["type"] == "Split" for s in parts)
    return (
        bool(parts) and (byte_level or removed) and all(map(split, parts)) and not tokens
        and all(map(normal, steps(rules["normalizer"], "normalizers"))) and rules["model"]["type"] == "BPE"
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """The text cut at safe places; joined again they are the text."""
    if text[:1] == " " or any(x in text for x in _DOUBLE) or not text.isascii() and _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Counter:
    """Counts tokens; remembers pieces, up to a bound on their characters."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, known_bytes: int = KNOWN_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = pieces if _cuts_are_safe(json.loads(self.tokenizer.to_str())) else lambda text: [text]
        self.batch_bytes, self.known_bytes = batch_bytes, known_bytes
        self.known: dict[str, int] = {}
        self.held = 0

    def learn(self, new: list[str]) -> None:
        """Encode pieces in batches of about ``batch_bytes``; only lengths are kept."""
        batch, size = [], 0
        for piece in new:
            batch.append(piece)
            size += len(piece) + 16
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)
        self.held += 2 * sum(map(len, new))

    def _encode(self, batch: list[str]) -> None:
        self.known.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts are taken together up to some bytes, so that few batches are small."""
        out: list[int] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= 8 * self.batch_bytes:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[int]:
        if self.held > self.known_bytes:
            self.known, self.held = {}, 0
        parts = [self.cut(x) for x in texts]
        self.learn([x for x in set().union(*parts) if x not in self.known])
        known = self.known.__getitem__
        return [sum(map(known, x)) for x in parts]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, UTF-8 bytes, tokens and whether they are over the limit, for every whole text.

    One pass, no shuffle. Null and empty texts have 0 bytes and 0 tokens, null ids stay null, rows that repeat are counted each,
    an empty table gives no rows; other columns, also ones that differ in case only, are not read. A special token's string
    inside a text counts as the library counts it by default, as that token. ``path`` is a tokenizer file every executor has.
    """
    path = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counter.counts(texts)
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )
