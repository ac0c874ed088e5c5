"""Named queries over records as they are read and kept: catalogue, snapshots, descriptions, scores of questions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import judging as J
from groundwork.operators import layout as L
from groundwork.plans.books import WS
from groundwork.plans.measurement import _HAS, _SCORED, _scored
from groundwork.plans.state import _LINES, _lines
from groundwork.session import table
from groundwork.sources import sinks


def catalogue_scan(spark, d: str) -> DataFrame:
    """Every game with its spellings as text."""
    return table(spark, d, "spiele").select("spiel_id", "spiel_name", F.array_join(F.transform(F.coalesce("aliase", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "|").alias("aliase"), F.coalesce(F.size("buecher"), F.lit(0)).alias("buecher"))


CATALOGUE_SQL = f"select spiel_id, spiel_name, array_to_string(list_transform(coalesce(aliase, []), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), '|') aliase, cast(coalesce(len(buecher), 0) as int) buecher from spiele"


def snapshot_lookup(spark, d: str) -> DataFrame:
    """Snapshots by game and configuration: number of chunks and length of their vectors."""
    c = table(spark, d, "chunks").where("spiel_id is not null")
    return c.groupBy("spiel_id", "konfig").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("emb")).alias("dim"))


SNAPSHOT_SQL = "select spiel_id, konfig, count(*) n, cast(max(len(emb)) as int) dim from chunks where spiel_id is not null group by 1, 2"


def index_order(spark, d: str) -> DataFrame:
    """Chunks of every game without those of dropped types, in the order of their positions."""
    from groundwork.operators import ranking as R

    c = R.drop_types(table(spark, d, "chunks").where("spiel_id is not null"), ["flavor", "meta"])
    g = c.groupBy("spiel_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    return g.select("spiel_id", F.md5(F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ",")).alias("folge"))


ORDER_SQL = "select spiel_id, md5(string_agg(id, ',' order by pos, id)) folge from chunks where spiel_id is not null and (typ is null or trim(typ) not in ('flavor', 'meta')) group by 1"


def described_collections(spark, d: str) -> DataFrame:
    """Descriptions of games after an update that leaves most fields open: every second game gets a language, a new one is added."""
    old = table(spark, d, "spiele").dropDuplicates(["spiel_id"]).select("spiel_id", "spiel_name", "sprache", "quelle_pdf")
    new = old.where(F.length("spiel_id") % 2 == 0).select("spiel_id", F.lit(None).cast("string").alias("spiel_name"), F.lit("xx").alias("sprache"))
    new = new.unionByName(spark.createDataFrame([("zz-neu", "Neu", None)], "spiel_id string, spiel_name string, sprache string"))
    return sinks.upserted(old, new, "spiel_id", {"sprache": "de"})


DESCRIBED_SQL = """
with o as (select spiel_id, any_value(spiel_name) spiel_name, any_value(sprache) sprache, any_value(quelle_pdf) quelle_pdf from spiele group by 1)
select spiel_id, spiel_name, case when length(spiel_id) % 2 = 0 then 'xx' else coalesce(sprache, 'de') end sprache, quelle_pdf from o union all select 'zz-neu', 'Neu', 'de', null
"""


def question_scores(spark, d: str) -> DataFrame:
    """One score row an answer: category and the keywords it has; answers that should refuse also count the fixed sentences."""
    s = _scored(spark, d).where("kategorie is not null")
    hits = F.coalesce(T.keyword_hits(F.coalesce("antwort", F.lit("")), F.coalesce("keywords", F.array().cast("array<string>"))), F.array().cast("array<string>"))
    fixed = F.array(F.lit(J.NOT_CLEAR[:-1]), F.lit(J.NOTHING[:-1]))
    signal = F.when(F.col("kategorie") == "verweigerung", T.keyword_hits(T.single_spaced(F.coalesce("antwort", F.lit(""))), fixed)).otherwise(F.array().cast("array<string>"))
    every = F.concat(hits, F.array_except(signal, hits))
    return s.select("antwort_id", "kategorie", F.size(every).alias("n"), F.array_join(F.transform(every, F.trim), "|").alias("treffer"))


SCORES_SQL = f"""
with {_SCORED}, k as (select s.antwort_id, s.kategorie, coalesce(s.antwort, '') antwort, list_transform(list_filter(coalesce(g.keywords, []), lambda x: x is not null and trim(x) <> ''), lambda x: trim(x)) k
  from s join golden_set g on g.spiel_id = s.spiel_id and g.frage_id = s.frage_id where s.kategorie is not null),
h as (select antwort_id, kategorie, list_concat(list_filter(k, lambda x: {_HAS.format('antwort', 'x')}), case when kategorie = 'verweigerung' then list_filter(['{J.NOT_CLEAR[:-1]}', '{J.NOTHING[:-1]}'], lambda x: contains(antwort, x)) else [] end) t from k)
select antwort_id, kategorie, cast(len(t) as int) n, array_to_string(t, '|') treffer from h
"""


def ingest_protocol(spark, d: str) -> DataFrame:
    """Lines, margins and sections of every text, five lines a section."""
    lines = _lines(spark, d)
    parts = lines.select("doc_id", F.floor(F.col("line_no") / 5).alias("s")).distinct()
    return L.protocol(lines, parts, L.in_margin(F.col("top"), F.col("bottom"), F.col("page_h"), 30.0, 60.0))


PROTOCOL_SQL = f"with {_LINES} select doc_id, count(*) zeilen, count(*) filter (t + 6 <= 30 or t + 6 >= 740) randzeilen, count(*) filter (t is null) ohne_lage, count(distinct floor(n / 5)) abschnitte from ln group by 1"


def heading_lists(spark, d: str) -> DataFrame:
    """A table of contents per game out of its chunks, with physical pages."""
    c = table(spark, d, "chunks").where("spiel_id is not null and seite is not null and size(abschnittspfad) > 0")
    e = c.select(F.col("spiel_id").alias("doc_id"), F.col("id").alias("entry_no"), F.concat(F.lit("  "), F.col("abschnittspfad")[0], F.lit("  ")).alias("titel"), F.lit(None).cast("int").alias("ebene"), "seite")
    return L.heading_list(e, 4)


HEADING_SQL = r"select spiel_id doc_id, id entry_no, trim(regexp_replace(abschnittspfad[1], '\s+', ' ', 'g')) titel, 1 ebene, seite + 4 page from chunks where spiel_id is not null and seite is not null and len(abschnittspfad) > 0"

QUERIES = {
    "catalogue_scan": catalogue_scan, "snapshot_lookup": snapshot_lookup, "index_order": index_order, "described_collections": described_collections, "question_scores": question_scores,
    "ingest_protocol": ingest_protocol, "heading_lists": heading_lists,
}
SQL = {
    "catalogue_scan": CATALOGUE_SQL, "snapshot_lookup": SNAPSHOT_SQL, "index_order": ORDER_SQL, "described_collections": DESCRIBED_SQL, "question_scores": SCORES_SQL, "ingest_protocol": PROTOCOL_SQL,
    "heading_lists": HEADING_SQL,
}
