"""Token ids of whole texts by a public byte-level BPE vocabulary, and back.

The tokenizers library encodes Arrow batches; a task keeps one tokenizer. Offsets are code points
of the text. Decoding reverses the byte table of the vocabulary, so ids whose bytes end in the
middle of a character can be joined and decoded later.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import table

#: Where the vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters encoded in one call: bounds a worker's memory, not the texts.
CALL_CHARS = 200_000


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, name + ".json"))
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary, reversed.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def bytes_of_id(name: str, folder: str) -> dict[int, bytes]:
    table_ = byte_of_char()
    with open(os.path.join(folder, name + ".json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {i: bytes(table_[c] for c in token) for token, i in vocabulary.items() if all(c in table_ for c in token)}


def _calls(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for k, t in enumerate(texts):
        if k > start and chars + len(t) > CALL_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(t)
    if texts:
        yield start, len(texts)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", name: str = VOCABULARY, folder: str = TOKENIZERS, offsets: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text``; with ``offsets``, also start and end of each token in code points.

    An empty and a null text give an empty list. Whole texts are encoded, of any length, without
    special tokens. A column named like a new one is an error.
    """
    new = [ids] + ([offsets] if offsets else [])
    if clash := set(new) & set(df.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    out = df.withColumn(ids, F.expr("cast(null as array<int>)"))
    if offsets:
        out = out.withColumn(offsets, F.expr("cast(null as array<struct<von:int,bis:int>>)"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        pair = pa.struct([("von", pa.int32()), ("bis", pa.int32())])
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in _calls(texts):
                # encode_batch_fast leaves the offsets out
                enc = (t.encode_batch if offsets else t.encode_batch_fast)(texts[a:b], add_special_tokens=False)
                cols = [*batch.slice(a, b - a).columns, pa.array([e.ids for e in enc], pa.list_(pa.int32()))]
                if offsets:
                    cols.append(pa.array([[{"von": s, "bis": e} for s, e in x.offsets] for x in enc], pa.list_(pair)))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *new])

    return df.mapInArrow(run, out.schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the text of its ids. Null ids give null, an empty list the empty text; an unknown id is left out.

    Bytes of all tokens are joined before they are read as UTF-8, so a character split over tokens
    is whole again; what is no UTF-8 even then becomes U+FFFD.
    """
    if text in df.columns:
        raise ValueError(f"the table already has {text}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bytes_of_id(name, folder)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if r is None else b"".join(b.get(i, b"") for i in r).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, df.withColumn(text, F.lit(None).cast("string")).schema)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: whether the text came back."""
    d = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("gleich"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
SQL = {"p8_roundtrip": "select doc_id, true gleich from documents"}
