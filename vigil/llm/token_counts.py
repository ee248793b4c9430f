"""Token counts by a two-tier lookup on the map side.

A byte-level BPE cuts a text into pre-tokens (by a fixed pattern) and encodes each by itself, so a text's token count
is the sum of its pre-tokens' lengths. The first tier is a compact table, sent to all workers once: the pre-tokens that
the vocabulary itself holds whole, which are those that were frequent enough to be merged. Its size is bounded by the
vocabulary. What misses it is looked up in the worker's own cache and only then encoded by the library; the cache lives
as long as the worker and is emptied at ``CACHE`` entries, so memory is bounded. No pre-token is ever shuffled.

The strings of special tokens in a text count as one token each, which is the library's default. Characters for which
the pattern library and the tokenizer library may know different Unicode versions make a text go to the library whole;
so do tokenizers of another make (``.json`` that aren't plain byte-level, and sentencepiece ``.model``).

Defined results: a null text has no bytes and no tokens; repeated rows are counted alike; extra columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.plans.shipping import ship

CACHE = 400_000
LIMIT = 512
#: Longer texts are matched piece by piece, not into one list.
LONG = 2_000_000
#: Fixed value: the published pattern of byte-level BPE pre-tokens.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Blocks in which all Unicode versions in use agree on letters, numbers and white space.
_UNSURE = regex.compile(r"[^\x00-\u0530\u2000-\u2080\u2100-\ua7c0\uac00-\ud7a3]")


def _unmapped() -> dict[str, int]:
    """The byte for each character that byte-level vocabularies write: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def _plain_byte_level(spec: dict) -> bool:
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    flags = any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    return bool(own and model and not flags and spec.get("normalizer") is None)


def frequent_lengths(spec_text: str) -> dict[str, int]:
    """Of all vocabulary entries that are one pre-token, the number of tokens; empty for other kinds of tokenizer."""
    spec = json.loads(spec_text)
    if not _plain_byte_level(spec):
        return {}
    byte, special, out = _unmapped(), {a["content"] for a in spec["added_tokens"]}, []
    for entry in spec["model"]["vocab"]:
        try:
            text = bytes(byte[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if entry not in special and not _UNSURE.search(text) and PATTERN.findall(text) == [text]:
            out.append(text)
    coded = _tokenizer(spec_text).encode_batch(out, add_special_tokens=False)
    return {t: len(c.ids) for t, c in zip(out, coded, strict=True)}


def _tokenizer(spec_text: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec_text)
    out.no_truncation()
    out.no_padding()
    return out


class _Lengths(dict):
    """The first tier; what it misses goes to the cache, then to the library."""

    def __init__(self, spec_text: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.cache = _tokenizer(spec_text), {}
        special = [a["content"] for a in json.loads(spec_text).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tiers = bool(frequent)

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.whole(piece)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = n
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.tiers or not text.isascii() and _UNSURE.search(text):
            return self.whole(text)
        found = self.special.findall(text) if self.special else []
        parts = self.special.split(text) if found else [text]
        n = len(found)
        for part in parts:
            pieces = PATTERN.findall(part) if len(part) < LONG else (m.group() for m in PATTERN.finditer(part))
            n += sum(map(self.__getitem__, pieces))
        return n


_workers: dict[int, object] = {}


def _counter(key: int, spec_text: str | None, frequent: dict[str, int], model: bytes | None):  # noqa: ANN202
    """This worker's counting function, made once."""
    if key not in _workers:
        if model is not None:
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_proto=model)
            _workers[key] = lambda text: len(own.encode(text))
        else:
            _workers[key] = _Lengths(spec_text, frequent).count
    return _workers[key]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document its id, n_bytes, n_tokens and whether these are over ``limit``. The tokenizer's file is read by the
    driver and sent to the workers."""
    spark = docs.sparkSession
    ship(spark)
    data = Path(tokenizer_path).read_bytes()
    spec, model = (None, data) if tokenizer_path.endswith(".model") else (data.decode(), None)
    sent = spark.sparkContext.broadcast((spec, frequent_lengths(spec) if spec else {}, model))
    key = hash(data)
    df = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__vg_text"), F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(key, *sent.value)
        for batch in batches:
            n = [count(x) if (x := t.as_py()) else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([df.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return df.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
