"""Broken question and answer pairs, each with one kind of defect.

Refusals are not listed anywhere but found. The opening of an answer is its first sentence, without a
label before it and without the question, numbers and the question's words masked. Openings are
clustered by verified MinHash, and a cluster that recurs over unrelated kinds of questions (price,
permission, number, start ...) of its language about as often as these are asked says nothing about
any of them: it is a refusal. An opening that belongs to some kinds of question ("Yes", "14 points")
is an answer, though wrong answers carry it to the others now and then. A refusal must also come more
often to questions that it is the right answer to; what has no tie to any question and does not is no
sentence of the question's language, unless nearly all of its words are. The other defects are checked
on the pair itself: nothing said, only the question, another language than the question's, broken
off; answers with one of these do not take part in the search for refusals.

Whether an answer without an end mark is complete is learned the same way: a whole answer whose
template recurs is a short answer, one that nothing else resembles broke off.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.language import Guess, normal_language, script, vocabulary
from groundwork.llm.near_duplicates import components
from groundwork.session import cut, table

KINDS = ("leer", "kopie", "fremdsprache", "verweigerung", "abgeschnitten")
#: What stands for "no value".
NOTHING = {"null", "none", "nil", "n a", "na", "nan", "undefined", "keine antwort", "no answer"}
#: A cluster of openings refuses if it opens so many answers of a language, and covers this share of the kinds of
#: questions that openings without any tie to the question would cover. Kinds asked less often are not looked at.
LEAST_SUPPORT, LEAST_COVER, KIND_SHARE = 5, 0.5, 0.01
#: A refusal's share of questions that are rightly refused is so many times that of all answers (smoothed by half an answer).
LEAST_LIFT = 2.0
#: An opening is native to a language whose questions it answers at this share of its rates over all languages.
NATIVE_SUPPORT, NATIVE_SHARE = 8, 0.9
#: A whole answer without an end mark is complete if its template makes up this share of such answers.
COMPLETE_SHARE, COMPLETE_SUPPORT = 0.0005, 3
#: MinHash over runs of three characters: HASHES values in bands of two, verified at SIMILARITY.
HASHES, SIMILARITY = 24, 0.7
#: Up to so many refusing templates travel as a broadcast table.
BROADCAST_ROWS = 20_000

WORD = re.compile(r"[^\W_]+", re.UNICODE)
LABEL = re.compile(r"^[\s*_#>\-]*(?:[^\W\d_][\w'’]*[  ]){0,3}[^\W\d_][\w'’]*[   ]?[:：][\s*_]*", re.UNICODE)
END = re.compile(r"[.!?…。！？]+[\"'“”«»„’)\]]*(?:\s+|$)|[。！？]")
CLOSED = re.compile(r"[.!?…。！？:][\"'“”«»’)\]*_\s]*$|[.!?…。！？)\]][)\]\"'“”»*_]*$")
OPEN_END = re.compile(r"[,;(\[„«–\-/&]$|[\[(][^)\]]*$")


def folded(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def bare(answer: str, question: str) -> tuple[str, str]:
    """(answer without labels, the same without leading copies of the question)."""
    t = answer.strip().strip("​﻿")
    while (m := LABEL.match(t)) and m.end():
        t = t[m.end() :]
    rest = t
    q = folded(question)
    while q:
        spans = [m.span() for m in WORD.finditer(rest)]
        if len(spans) < len(q) or [rest[a:b].casefold() for a, b in spans[: len(q)]] != q:
            break
        rest = rest[spans[len(q) - 1][1] :].lstrip(" \t\n?!.:：？*_\"'“”«»")
        while (m := LABEL.match(rest)) and m.end():
            rest = rest[m.end() :]
    return t, rest.strip()


def template(text: str, question: str, least: int = 4) -> str:
    """Words in lower case; numbers, words of the question and names inside the text masked."""
    asked = {w for w in folded(question) if len(w) >= least}
    out = []
    for k, m in enumerate(WORD.finditer(text)):
        w = m.group()
        low = w.casefold()
        if any(c.isdigit() for c in w):
            out.append("#")
        elif k and (low in asked or w[0].isupper()):
            out.append("@")
        else:
            out.append(low)
    return " ".join(out)


def describe(answer: str | None, question: str | None, guess: Guess) -> dict:
    """What one pair shows by itself."""
    q, a = question or "", answer or ""
    label, rest = bare(a, q)
    words = folded(rest)
    asked = folded(q)
    out = {"kind": None, "lang": guess.best(q), "group": " ".join(asked[:2]) or None, "opening": None, "whole": None, "cut": False, "odd": False, "own": False}
    if not folded(label) or " ".join(folded(label)) in NOTHING:
        return out | {"kind": "leer"}
    if asked and not words:
        return out | {"kind": "kopie"}
    if not words or " ".join(words) in NOTHING:
        return out | {"kind": "leer"}
    if asked and guess.foreign(rest, out["lang"], script(q) == "latin"):
        return out | {"kind": "fremdsprache", "opening": template(rest[: m.end()] if (m := END.search(rest)) else rest, q)}
    # words of no vocabulary: the opening's use over the languages will tell
    out["odd"] = bool(asked) and guess.odd(rest)
    out["own"] = guess.own(rest, out["lang"])
    m = END.search(rest)
    first = rest[: m.end()] if m else rest
    out["opening"] = template(first, q)
    if not CLOSED.search(rest):
        if OPEN_END.search(rest) or (m and m.end() < len(rest)):
            out["cut"] = True
        else:
            out["whole"] = template(rest, q, 1)
    return out


def pairs_of(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per answer, with its question and whether refusing it is right."""
    a = answers.where("antwort_id is not null").select("antwort_id", "spiel_id", "frage_id", "frage", "antwort").dropDuplicates(["antwort_id"])
    g = questions.where("spiel_id is not null and frage_id is not null").groupBy("spiel_id", "frage_id").agg(F.min("frage").alias("gefragt"), F.max("erwartet_verweigerung").alias("erlaubt"))
    j = a.join(g, ["spiel_id", "frage_id"], "left")
    return j.select("antwort_id", F.coalesce("frage", "gefragt").alias("frage"), "antwort", F.coalesce("erlaubt", F.lit(False)).alias("erlaubt"))


def _clusters(openings: DataFrame) -> DataFrame:
    """(opening, root) for the distinct openings, by MinHash bands verified on their character runs.

    A band's members are compared with its least id first; those still in different clusters after
    that are compared with each other, so a band costs its square only as far as it is several clusters.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("opening") - 2, F.lit(1))), lambda i: F.substring("opening", i, F.lit(3))))
    d = cut(openings.select("opening").distinct().select("opening", F.xxhash64("opening").alias("id"), grams.alias("g")))

    def least(seed: int):
        return F.array_min(F.transform("g", lambda x: F.xxhash64(x, F.lit(seed))))

    bands = d.select("id", F.array(*[least(k) for k in range(HASHES)]).alias("m"))
    bands = cut(bands.select("id", F.explode(F.array(*[F.xxhash64(F.lit(b), F.get("m", 2 * b), F.get("m", 2 * b + 1)) for b in range(HASHES // 2)])).alias("band")))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(d.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(d.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
        n = F.size(F.array_intersect("ga", "gb"))
        return both.where(n >= SIMILARITY * (F.size("ga") + F.size("gb") - n)).select("a", "b")

    centre = bands.groupBy("band").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(alike(bands.join(centre, "band").where("id <> b").select(F.col("id").alias("a"), "b")))
    group = components(first)
    placed = cut(bands.join(group, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")))
    x, y = placed.alias("x"), placed.alias("y")
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    group = components(first.unionByName(alike(rest)))
    return d.join(group, "id", "left").select("opening", F.coalesce("root", "id").alias("root"))


def untied(counted: DataFrame, cluster: DataFrame, asked: DataFrame) -> DataFrame:
    """(root, lang, welcome) of the clusters that recur over unrelated kinds of questions.

    ``counted`` has (opening, lang, group, n, right), ``asked`` how often each kind (lang, group) is
    answered, and how many of these are rightly refused. If an opening had no tie to the questions, a
    kind would have a Poisson number of it with the mean ``e = size * share``; of ``min(1, n / e)`` the
    mean is then 1 less the probability of floor(e). ``welcome``: it comes where refusing is right.
    """
    every = asked.groupBy("lang").agg(F.sum("asked").alias("every"), F.sum("right").alias("rightly"))
    kinds = asked.join(every, "lang").select("lang", "group", (F.col("asked") / F.col("every")).alias("share")).where(F.col("share") >= KIND_SHARE)
    c = counted.join(cluster, "opening").groupBy("root", "lang", "group").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    size = c.groupBy("root", "lang").agg(F.sum("n").alias("size"), F.sum("right").alias("right")).where(F.col("size") >= LEAST_SUPPORT)
    lift = (F.col("right") + 0.5) / (F.col("size") + 1) >= LEAST_LIFT * F.col("rightly") / F.col("every")
    size = size.join(every, "lang").select("root", "lang", "size", (lift | (F.col("rightly") == 0)).alias("welcome"))
    e = F.col("size") * F.col("share")
    m = F.floor(e).cast("double")
    # Stirling's series is exact enough from 1 on; 0! is 1
    log_factorial = F.when(m < 1, 0.0).otherwise(m * F.log(m) - m + 0.5 * F.log(2 * math.pi * m) + 1 / (12 * m))
    chance = F.exp(m * F.log(e) - e - log_factorial)
    grid = size.join(kinds, "lang").join(c.select("root", "lang", "group", "n"), ["root", "lang", "group"], "left")
    cover = grid.groupBy("root", "lang", "welcome").agg(F.sum(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / e)).alias("seen"), F.sum(1 - chance).alias("due"))
    return cover.where(F.col("seen") >= LEAST_COVER * F.col("due")).select("root", "lang", "welcome")


def defects(answers: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(antwort_id, defekt) of every defective answer.

    ``texts`` has (text, lang), the source of the vocabularies. An answer delivered again is one
    answer; a null answer is ``leer``; an answer without any question can be empty, broken off or a
    refusal, but no copy and in no wrong language. Rows without ``antwort_id`` are left out, an empty
    table gives no rows. Of several defects the first of ``KINDS`` counts.
    """
    spark = answers.sparkSession
    words = vocabulary(texts)
    languages = {x for v in words.values() for x in v}
    shared = spark.sparkContext.broadcast((words, languages))
    schema = "antwort_id bigint, erlaubt boolean, kind string, lang string, `group` string, opening string, whole string, cut boolean, odd boolean, own boolean"
    names = ["kind", "lang", "group", "opening", "whole", "cut", "odd", "own"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Guess(*shared.value)
        text, flag = pa.string(), pa.bool_()
        for b in batches:
            d = b.to_pydict()
            rows = [describe(a, q, guess) for a, q in zip(d["antwort"], d["frage"])]
            cols = [pa.array([r[n] for r in rows], flag if n in ("cut", "odd", "own") else text) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(d["antwort_id"], pa.int64()), pa.array(d["erlaubt"], flag), *cols], names=["antwort_id", "erlaubt", *names])

    seen = cut(pairs_of(answers, questions).mapInArrow(run, schema))
    # openings that name something (a mere number is an answer)
    said = seen.where(F.col("kind").isNull() & F.col("opening").rlike(r"\p{L}{2}"))
    opened = seen.where(F.col("opening").rlike(r"\p{L}{2}") & F.col("group").isNotNull())
    cluster = cut(_clusters(opened))
    counted = said.where(F.col("group").isNotNull()).groupBy("opening", "lang", "group").agg(F.count(F.lit(1)).alias("n"), F.count_if("erlaubt").alias("right"))
    asked = seen.where("group is not null").groupBy("lang", "group").agg(F.count(F.lit(1)).alias("asked"), F.count_if("erlaubt").alias("right"))
    loose = untied(counted, cluster, asked)
    # a template belongs to a language if it answers that language's questions far more often than any other's
    total = asked.groupBy("lang").agg(F.sum("asked").alias("every"))
    of = opened.where("lang is not null").groupBy("opening", "lang").agg(F.count(F.lit(1)).alias("n")).join(cluster, "opening")
    of = of.groupBy("root", "lang").agg(F.sum("n").alias("n")).join(total, "lang").withColumn("rate", F.col("n") / F.col("every"))
    native = of.groupBy("root").agg(F.max_by("lang", "rate").alias("native"), F.max("rate").alias("most"), F.sum("rate").alias("all"), F.sum("n").alias("n")).where(F.col("n") >= NATIVE_SUPPORT)
    native = native.select("root", F.when(F.col("most") >= NATIVE_SHARE * F.col("all"), F.col("native")).otherwise("").alias("native"))
    # no more entries than languages
    loose = loose.groupBy("root").agg(F.collect_set(F.when(F.col("welcome"), F.col("lang"))).alias("refuses"), F.collect_set(F.when(~F.col("welcome"), F.col("lang"))).alias("loose"))
    known = cluster.join(loose, "root", "left").join(native, "root", "left")
    refusing = cut(known.where("refuses is not null or native is not null").select("opening", "refuses", "loose", "native"))
    whole = seen.where("whole is not null").groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    total = whole.agg(F.sum("n")).first()[0] or 0
    complete = cut(whole.where(F.col("n") >= max(COMPLETE_SUPPORT, COMPLETE_SHARE * total)).select("whole", F.lit(True).alias("complete")))
    if refusing.count() <= BROADCAST_ROWS:
        refusing = F.broadcast(refusing)
    if complete.count() <= BROADCAST_ROWS:
        complete = F.broadcast(complete)
    j = seen.join(refusing, "opening", "left").join(complete, "whole", "left")
    refuses = F.coalesce(F.array_contains("refuses", F.col("lang")), (F.size("refuses") > 0) & F.col("lang").isNull(), F.lit(False))
    off = F.col("cut") | (F.col("whole").isNotNull() & F.col("complete").isNull())
    strange = F.col("odd") & ~F.coalesce(F.col("native") == F.col("lang"), F.lit(False))
    strange = F.coalesce(strange | (F.array_contains("loose", F.col("lang")) & ~F.col("own")), strange)
    kind = F.when(F.col("kind").isNotNull(), F.col("kind")).when(strange, "fremdsprache").when(refuses, F.when(~F.col("erlaubt"), "verweigerung")).when(off, "abgeschnitten")
    return j.select("antwort_id", kind.alias("defekt")).where("defekt is not null")


def language_texts(spark, sf_dir: str) -> DataFrame:
    """(text, lang) of chunks, and of questions and expected answers by their game's language."""
    chunks = table(spark, sf_dir, "chunks").select("text", normal_language(F.col("sprache")).alias("lang"))
    games = table(spark, sf_dir, "spiele").select("spiel_id", normal_language(F.col("sprache")).alias("lang")).dropDuplicates(["spiel_id"])
    asked = table(spark, sf_dir, "golden_set").select("spiel_id", F.concat_ws("\n", "frage", "erwartet").alias("text")).join(games, "spiel_id")
    return chunks.unionByName(asked.select("text", "lang")).where("lang in ('de', 'en', 'fr')")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "antworten"), table(spark, sf_dir, "golden_set"), language_texts(spark, sf_dir))


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
