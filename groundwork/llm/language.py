"""Telling languages apart by how often each language uses a text's words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words the vocabulary keeps, the commonest first; it travels to every task.
VOCABULARY = 60_000
LEAST_SEEN = 2
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.UNICODE)


def normal_language(c: Column) -> Column:
    """The bare code of a language in any of its spellings (``DE``, ``de-DE``); null where it is none."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when((code != "") & ~code.isin("xx"), code)


def script(text: str) -> str:
    """``latin``, or the name of the script that most letters of the text have."""
    seen: dict[str, int] = {}
    for ch in text:
        if ch.isalpha():
            if ch < "ɐ":
                s = "latin"
            else:
                s = unicodedata.name(ch, "other").split(" ")[0].lower()
                s = "latin" if s == "latin" else "han" if s in ("cjk", "hiragana", "katakana") else s
            seen[s] = seen.get(s, 0) + 1
    return max(seen, key=lambda k: (seen[k], k)) if seen else ""


def vocabulary(texts: DataFrame, words: int = VOCABULARY) -> dict[str, dict[str, float]]:
    """{word: {language: log of its share}} of the commonest words of (text, lang), counted over all rows.

    At most ``words`` entries reach the driver, whatever the number of texts.
    """
    w = texts.where("text is not null and lang is not null").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))).alias("word"))
    c = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    total = {r["lang"]: r["n"] for r in c.groupBy("lang").agg(F.sum("n").alias("n")).collect() if r["n"] > 0}
    top = c.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all") >= LEAST_SEEN)
    out: dict[str, dict[str, float]] = {}
    for r in top.orderBy(F.desc("all"), "word").limit(words).toLocalIterator():
        out[r["word"]] = {x["lang"]: math.log(x["n"] / total[x["lang"]]) for x in r["by"]}
    return out


class Guess:
    """Languages of texts by a vocabulary."""

    #: Log share of a word that a language does not have; and how much of it a single stray label counts.
    MISSING = -16.0

    def __init__(self, words: dict[str, dict[str, float]], languages: Iterable[str]):
        self.words, self.languages = words, sorted(languages)

    def scores(self, text: str) -> tuple[dict[str, float], int, int]:
        """(mean log share by language over the known words, known words, all words)."""
        found = [w for w in WORD.findall(text.lower())]
        known = [self.words[w] for w in found if w in self.words]
        if not known:
            return {}, 0, len(found)
        return {x: float(np.mean([k.get(x, self.MISSING) for k in known])) for x in self.languages}, len(known), len(found)

    def best(self, text: str) -> str | None:
        s, known, _ = self.scores(text)
        return max(s, key=lambda k: (s[k], k)) if s else None

    def odd(self, text: str) -> bool:
        """Whether most words of the text are in no vocabulary."""
        _, known, every = self.scores(text)
        return every >= 2 and known < 0.4 * every

    def own(self, text: str, language: str | None) -> bool:
        """Whether most words of the text are known and ``language`` has them most."""
        s, known, every = self.scores(text)
        return known >= 0.6 * every and bool(s) and max(s, key=lambda k: (s[k], k)) == language

    def foreign(self, text: str, language: str | None, latin: bool = True) -> bool:
        """Whether the text is surely not in ``language``: it has another script or another language's words."""
        own = script(text)
        if not own:
            return False
        if (own == "latin") != latin:
            return True
        if not latin or language is None:
            return False
        s, known, every = self.scores(text)
        if not s or known < 0.4 * every:
            return False
        other = max(v for k, v in s.items() if k != language) if len(s) > 1 else self.MISSING
        need = 3.0 if known == 1 else 2.2 if known < 4 else 1.2
        return other - s.get(language, self.MISSING) > need
