"""Test passages that occur, whole or in part and with small changes, in documents.

A leak is a stretch of at least 15 successive words of a passage of which at most one in eight is
altered, left out or added. Texts are compared as folded words (see ``folded``).

Filter. By the q-gram lemma such a stretch keeps at least ``threshold`` of its character q-grams,
and they lie near one diagonal. A batch of documents is hashed as one array; hits are counted per
passage in overlapping bands of diagonals, and only bands with enough hits stay. Verification. In
such a band a banded alignment over words, for all starts in the passage at once, decides exactly.

The test set is small against the corpus: it is read in blocks of a checked size, and each block
passes once over the documents, which are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import table

LEAST_WORDS, ONE_IN = 15, 8
#: Characters of a q-gram: five words without a change are longer, and a stretch keeps five together.
Q = 14
#: Diagonals of a band, in words; bands overlap by half, and the alignment may leave its band by as much.
BAND = 8
#: Characters of passages that travel to the tasks at once.
BLOCK_CHARS = 2_000_000
#: A stretch of twice this length or more contains a shorter one that is a leak too.
LONGEST = 2 * (LEAST_WORDS + 1) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20

WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: Spellings of one letter, and signs without width.
SPELLINGS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "­": None, "​": None, "‌": None, "‍": None, "﻿": None, "⁠": None})


def folded(text: str) -> list[str]:
    """Words in one spelling: compatibility form, no case, ``ä`` as ``ae``, no marks without width."""
    return WORD.findall(unicodedata.normalize("NFKC", text).casefold().translate(SPELLINGS))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place."""
    with np.errstate(over="ignore"):
        power = {1: codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)}
        factor = {1: _BASE}
        n = 1
        while n * 2 <= Q:
            h = power[n]
            power[2 * n] = h[:-n] * factor[n] + h[n:]
            factor[2 * n] = factor[n] * factor[n]
            n *= 2
        have, out = n, power[n]
        while have < Q:
            step = max(k for k in power if k <= Q - have)
            tail = power[step][have:]
            m = min(len(out), len(tail))
            out = out[:m] * factor[step] + tail[:m]
            have += step
    return out ^ (out >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words with blanks between, word that each belongs to)."""
    text = " ".join(words)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(words)), lengths)[: len(text)]


@dataclass
class Index:
    """The q-grams of a block of passages."""

    items: np.ndarray
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    threshold: np.ndarray
    bitmap: np.ndarray


def threshold(words: list[str]) -> int:
    """Least q-grams that any leak of the passage shares.

    Of a stretch of n words n // 8 are lost, at worst its longest, each with the q-grams that touch it.
    The words left are in n // 8 + 1 runs, and the longest run keeps its q-grams whatever is lost elsewhere.
    """
    length = np.array([len(w) for w in words])
    sizes = np.cumsum([0, *(length + 1)])
    least = None
    for n in range(LEAST_WORDS, min(LONGEST, len(words)) + 1):
        lost = n // ONE_IN
        chars = sizes[n:] - sizes[:-n] - 1
        longest = np.partition(np.lib.stride_tricks.sliding_window_view(length, n), n - lost, axis=1)[:, n - lost :]
        kept = int((chars - Q + 1 - longest.sum(axis=1) - lost * (Q - 1)).min())
        run = -(-(n - lost) // (lost + 1))
        kept = max(kept, int((sizes[run:] - sizes[:-run]).min()) - 1 - Q + 1)
        least = kept if least is None else min(least, kept)
    return max(1, least or 0)


def build(passages: list[tuple[int, str]]) -> Index | None:
    items, words, hashes, owner, place, bounds, vocabulary = [], [], [], [], [], [], {}
    for item, text in passages:
        w = folded(text)
        if len(w) < LEAST_WORDS:
            continue
        codes, at = _codes(w)
        if len(codes) < Q:
            continue
        h = _hashes(codes)
        hashes.append(h)
        owner.append(np.full(len(h), len(items)))
        place.append(at[: len(h)])
        words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w]))
        items.append(item)
        bounds.append(threshold(w))
    if not items:
        return None
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[grams >> np.uint64(64 - _BITS)] = True
    return Index(np.array(items), words, vocabulary, grams, np.append(first, len(h)), np.concatenate(owner)[order], np.concatenate(place)[order], np.array(bounds), bitmap)


def aligned(passage: np.ndarray, doc: np.ndarray, diagonal: int, width: int) -> bool:
    """Whether a stretch of the passage lies in the document within ``width`` diagonals from ``diagonal`` on."""
    starts = len(passage) - LEAST_WORDS + 1
    if starts < 1:
        return False
    i = np.arange(starts)
    b = np.arange(width)
    big = 1 << 20
    cost = np.zeros((starts, width), np.int32)
    pad = len(passage) + width + abs(diagonal) + 2
    text = np.concatenate([np.full(pad, -2), doc, np.full(pad, -2)])
    for r in range(min(LONGEST, len(passage))):
        inside = i + r < len(passage)
        word = passage[np.minimum(i + r, len(passage) - 1)]
        at = (i + r + diagonal)[:, None] + b[None, :]
        other = text[np.clip(at + pad, 0, len(text) - 1)]
        new = cost + (other != word[:, None])
        # the passage's word is left out: its follower stands one place further to the left
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        # words added in the document: running minimum over the band
        new = np.minimum.accumulate(new - b[None, :], axis=1) + b[None, :]
        new[~inside] = big
        cost = new
        if r + 1 >= LEAST_WORDS and (cost.min() * ONE_IN <= r + 1):
            return True
    return False


def leaks(texts: list[str | None], index: Index) -> list[list[int]]:
    """Items that each text leaks."""
    docs = [folded(t) if t else [] for t in texts]
    out: list[list[int]] = [[] for _ in texts]
    every = [w for d in docs for w in [*d, "\n" * Q]]
    if not every:
        return out
    codes, at = _codes(every)
    if len(codes) < Q:
        return out
    h = _hashes(codes)
    near = np.flatnonzero(index.bitmap[h >> np.uint64(64 - _BITS)])
    k = np.searchsorted(index.grams, h[near])
    k = np.minimum(k, len(index.grams) - 1)
    same = index.grams[k] == h[near]
    near, k = near[same], k[same]
    if not len(near):
        return out
    count = index.first[k + 1] - index.first[k]
    entry = np.repeat(index.first[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    word = np.repeat(at[near], count)
    passage, place = index.passage[entry], index.place[entry]
    ends = np.cumsum([len(d) + 1 for d in docs])
    doc = np.searchsorted(ends, word, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    diagonal = word - begin[doc] - place
    half = BAND // 2
    low = np.floor_divide(diagonal, half)
    span = int(max(abs(low.min()), abs(low.max()))) + 3
    key = (doc.astype(np.int64) * len(index.items) + passage) * (2 * span) + low + span
    found, hits = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    pair = found // (2 * span)
    strong = hits >= index.threshold[pair % len(index.items)]
    order = np.lexsort((-hits[strong], pair[strong]))
    done: set[int] = set()
    ids: dict[int, np.ndarray] = {}
    for f, p in zip(found[strong][order].tolist(), pair[strong][order].tolist()):
        if p in done:
            continue
        d, item = divmod(p, len(index.items))
        if d not in ids:
            ids[d] = np.array([index.vocabulary.get(w, -1) for w in docs[d]])
        start = (f % (2 * span) - span) * half
        if aligned(index.words[item], ids[d], start - half, BAND + 2 * half):
            done.add(p)
            out[d].append(int(index.items[item]))
    return out


def leaked(documents: DataFrame, passages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a leak of a passage.

    Whole documents are searched. Null and empty texts, rows without id, and passages under 15 words
    give no row; repeated rows give one. Other columns are not used, an empty table gives no rows.
    The passages are held in blocks of ``block_chars`` characters, one pass over the documents each.
    """
    spark = documents.sparkSession
    d = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = passages.where("item_id is not null and text is not null").select("item_id", "text").distinct()

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        held: list[Index | None] = []

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(build(shared.value))
            index = held[0]
            for batch in batches:
                if index is None:
                    continue
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a in range(0, len(ids), 256):
                    pairs = [(i, x) for i, items in zip(ids[a : a + 256], leaks(texts[a : a + 256], index)) for x in items]
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

        return d.mapInArrow(run, "doc_id bigint, item_id bigint")

    found, block, chars = None, [], 0

    def add(block):
        nonlocal found
        part = search(block)
        found = part if found is None else found.unionByName(part)

    for r in rows.toLocalIterator():
        if block and chars + len(r["text"]) > block_chars:
            add(block)
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        add(block)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return found.distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pruefpassagen"))


def p9_items(spark, sf_dir: str) -> DataFrame:
    """Per test item the number of documents that leak it."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("dokumente"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
