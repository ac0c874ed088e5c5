"""Records in JSON and JSON Lines files as tables, read with fixed schemas and checked before anything is computed.

A folder of collections holds one folder per collection, named by its key: ``spiel.json``, one ``.jsonl`` of
entries per book, and a golden set. Reads take whole folders at once: one job for all collections.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.books import KEY
from groundwork.operators.measuring import LABELS, VERDICTS

#: Schemas of the records.
ENTRY = "id bigint, seite int, seite_pdf int, typ string, route string, quelle string, roh string, text string, spiel string, spiel_id string, buch_id string, abschnittspfad array<string>, seitenwechsel array<array<int>>"
BOOK = "buch_id string, titel string, fassung string, sprache string, quelle string, inhaltsart string, inhaltsarten array<struct<praefix: array<string>, inhaltsart: string>>"
RULE = "massgeblich array<string>, gekennzeichnet map<string, string>"
COLLECTION = f"spiel_id string, name string, aliase array<string>, sprache string, quelle_pdf string, buecher array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2: ', BOOK)}>>, fassungsregeln map<string, struct<massgeblich: array<string>, gekennzeichnet: map<string, string>>>"
GOLDEN = "spiel_id string, fragen array<struct<id: int, frage: string, typ: string, erwartet: string, keywords: array<string>, seiten: array<int>, erwartet_verweigerung: boolean, verlauf: array<string>>>"
VERDICT = "spiel_id string, frage_id int, frage string, antwort string, typ string, urteil string, t_antwort double, sekunden double, input_tokens bigint, output_tokens bigint, deterministisch boolean"
CALIBRATION = "spiel_id string, frage_id int, antwort string, label string, fehlerart string, strittig boolean"
OVERRIDE = "zeile bigint, neu string, fehlerart string"


def failed(violations: DataFrame, what: str) -> None:
    """An error that names the first violations; nothing where there are none. Only five rows reach the driver."""
    if rows := violations.limit(5).collect():
        raise ValueError(f"{what}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows))


def checked_key(key: str) -> str:
    if not re.fullmatch(KEY, key):
        raise ValueError(f"no key of a collection: {key!r}")
    return key


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON Lines files; blank lines are none, a line that is no record of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def collections(spark: SparkSession, root: str) -> DataFrame:
    """One row per collection under ``root``, by its key: folders that are named by a key and hold a ``spiel.json`` of that key."""
    d = spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/spiel.json")
    d = d.withColumn("_ordner", F.regexp_extract(F.input_file_name(), r"([^/]+)/spiel\.json$", 1)).where(F.col("_ordner").rlike(KEY))
    failed(d.where(~F.col("spiel_id").eqNullSafe(F.col("_ordner")) | (F.coalesce(F.trim("name"), F.lit("")) == "")).select("_ordner", "spiel_id", "name"), "collections whose file says another key or no name")
    return d.drop("_ordner").orderBy("spiel_id")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all books of all collections; a row of another collection than its folder's, or without any page, is an error."""
    d = json_lines(spark, f"{root}/*/*.jsonl", ENTRY)
    d = d.withColumn("_ordner", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    failed(d.where(~F.col("spiel_id").eqNullSafe(F.col("_ordner"))).select("_ordner", "spiel_id", "id"), "entries of another collection")
    failed(d.where("seite is null and seite_pdf is null and buch_id is null").select("spiel_id", "id"), "entries without a page")
    return d.drop("_ordner")


def golden_questions(spark: SparkSession, root: str, name: str = "golden_set.json") -> DataFrame:
    """One row per question; a file that names another collection than its folder's, and a question twice, are errors."""
    if "/" in name or name.startswith("."):
        raise ValueError(f"the golden set is a bare file name: {name!r}")
    d = spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/{name}")
    d = d.withColumn("_ordner", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    failed(d.where(~F.col("spiel_id").eqNullSafe(F.col("_ordner"))).select("_ordner", "spiel_id"), "golden sets of another collection")
    q = d.select("spiel_id", F.explode("fragen").alias("f")).select("spiel_id", F.col("f.id").alias("frage_id"), "f.frage", "f.typ", "f.erwartet", "f.keywords", "f.seiten", "f.erwartet_verweigerung", "f.verlauf")
    failed(q.groupBy("spiel_id", "frage_id").count().where("count > 1"), "questions twice in a golden set")
    failed(pageless(q), "questions with neither pages nor a refusal expected")
    return q


def pageless(questions: DataFrame) -> DataFrame:
    """(spiel_id, frage_id) of questions that no hit rate could count: no page expected, and no refusal either."""
    return questions.where("not coalesce(erwartet_verweigerung, false) and coalesce(size(seiten), 0) <= 0").select("spiel_id", "frage_id")


def run_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts of one run; an empty run, a question twice and an unknown verdict are errors."""
    d = json_lines(spark, path, VERDICT)
    check_run(d)
    return d


def check_run(verdicts: DataFrame) -> None:
    if verdicts.limit(1).count() == 0:
        raise ValueError("the run has no verdicts")
    failed(verdicts.groupBy("spiel_id", "frage_id").count().where("count > 1"), "questions twice in a run")
    failed(verdicts.where(~F.coalesce(F.col("urteil").isin(*VERDICTS), F.lit(False))).select("spiel_id", "frage_id", "urteil"), "unknown verdicts")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """The labelled answers with their line (``zeile`` from 0, one file); an unknown label is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("zeile", "zeichen")).where("trim(zeichen) <> ''")
    d = lines.select(F.col("zeile").cast("bigint").alias("zeile"), F.from_json("zeichen", CALIBRATION, {"mode": "FAILFAST"}).alias("r")).select("zeile", "r.*")
    failed(d.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).select("zeile", "label"), "unknown labels")
    return d


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Labels that replace those of the calibration, by line; an unknown one is an error."""
    d = json_lines(spark, path, OVERRIDE)
    failed(d.where(~F.coalesce(F.col("neu").isin(*LABELS), F.lit(False))), "unknown labels")
    return d


def answers_with_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers joined to their questions; an answer whose question is unknown is an error before anything else is done."""
    failed(answers.join(questions, ["spiel_id", "frage_id"], "left_anti").select("spiel_id", "frage_id").distinct(), "answers to questions that are not in the golden set")
    return answers.join(questions, ["spiel_id", "frage_id"])
