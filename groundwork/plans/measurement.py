"""Named queries: scoring of answers, verdict metrics, run comparison, names and index state; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import measuring as M
from groundwork.session import table


def _scored(spark, d: str) -> DataFrame:
    a = table(spark, d, "antworten").where("antwort_id is not null").dropDuplicates(["antwort_id"])
    # physical pages, as the answers log them, against the expected ones
    g = table(spark, d, "golden_set").select("spiel_id", "frage_id", F.col("typ").alias("fragetyp"), "seiten", "erwartet_verweigerung", "keywords")
    j = a.join(g, ["spiel_id", "frage_id"])
    return j.withColumn("kategorie", M.category(F.col("erwartet_verweigerung"), F.col("seiten"), F.col("abgerufen")))


_SCORED = """
a as (select antwort_id, any_value(spiel_id) spiel_id, any_value(frage_id) frage_id, any_value(abgerufen) abgerufen, any_value(setting) setting, any_value(lauf) lauf,
  any_value(antwort) antwort from antworten where antwort_id is not null group by 1),
s as (select a.*, g.typ fragetyp, case when coalesce(erwartet_verweigerung, false) then 'verweigerung' when coalesce(len(seiten), 0) = 0 then null
  when coalesce(list_has_any(seiten, abgerufen), false) then 'getroffen' else 'verfehlt' end kategorie from a join golden_set g using (spiel_id, frage_id))
"""
_COUNTS = """count(*) fragen, count(*) filter (kategorie in ('getroffen', 'verfehlt')) nenner, count(*) filter (kategorie = 'getroffen') getroffen,
 count(*) filter (kategorie = 'verfehlt') verfehlt, count(*) filter (kategorie = 'verweigerung') verweigerung,
 round(count(*) filter (kategorie = 'getroffen') / nullif(cast(count(*) filter (kategorie in ('getroffen', 'verfehlt')) as double), 0), 6) quote"""


def eval_category(spark, d: str) -> DataFrame:
    return _scored(spark, d).select("antwort_id", "kategorie")


def eval_summary(spark, d: str) -> DataFrame:
    return M.hit_counts(_scored(spark, d), "setting")


def eval_by_type(spark, d: str) -> DataFrame:
    return M.hit_counts(_scored(spark, d), "setting", "fragetyp")


def hit_rate_by_game(spark, d: str) -> DataFrame:
    return M.hit_counts(_scored(spark, d), "spiel_id")


def precision_mrr(spark, d: str) -> DataFrame:
    """Precision of the retrieved pages and mean reciprocal rank of the first expected one, per setting."""
    s = _scored(spark, d).where("kategorie in ('getroffen', 'verfehlt') and size(abgerufen) > 0")
    hit = F.filter("abgerufen", lambda x: F.array_contains("seiten", x))
    first = F.array_min(F.filter(F.transform("abgerufen", lambda x, i: F.when(F.array_contains("seiten", x), i + 1)), lambda x: x.isNotNull()))
    g = s.groupBy("setting").agg(F.avg(F.size(hit) / F.size("abgerufen")).alias("p"), F.avg(F.coalesce(1.0 / first, F.lit(0.0))).alias("m"))
    return g.select("setting", F.round("p", 6).alias("precision"), F.round("m", 6).alias("mrr"))


PRECISION_SQL = f"""
with {_SCORED}, t as (select s.setting, s.abgerufen, g.seiten from s join golden_set g using (spiel_id, frage_id) where kategorie in ('getroffen', 'verfehlt') and len(abgerufen) > 0),
h as (select setting, len(list_filter(abgerufen, lambda x: list_contains(seiten, x))) / cast(len(abgerufen) as double) p,
  list_min(list_filter(list_transform(abgerufen, lambda x, i: case when list_contains(seiten, x) then i end), lambda y: y is not null)) f from t)
select setting, round(avg(p), 6) as "precision", round(avg(coalesce(1.0::double / f, 0)), 6) mrr from h group by 1
"""


def golden_missing(spark, d: str) -> DataFrame:
    """Questions that no answer of the first runs was delivered for."""
    a = table(spark, d, "antworten").where("lauf = 1").select("spiel_id", "frage_id")
    return table(spark, d, "golden_set").select("spiel_id", "frage_id").join(a, ["spiel_id", "frage_id"], "left_anti")


MISSING_SQL = "select spiel_id, frage_id from golden_set g where not exists (select 1 from antworten a where a.spiel_id = g.spiel_id and a.frage_id = g.frage_id and a.lauf = 1)"


def _verdicts(spark, d: str) -> DataFrame:
    u = table(spark, d, "urteile").dropDuplicates(["urteil_id"])
    return u.select("urteil_id", "spiel_id", "frage_id", "pruefer", T.normal_label(F.col("urteil")).alias("urteil"), "sekunden", "gefaellt")


_LABEL = r"regexp_replace(lower(urteil), '^[\s\x{a0}]+|[\s\x{a0}.!]+$', '', 'g')"
_VERDICTS = f"""
u as (select urteil_id, any_value(spiel_id) spiel_id, any_value(frage_id) frage_id, any_value(pruefer) pruefer, any_value(urteil) urteil, any_value(sekunden) sekunden from urteile group by 1),
v as (select urteil_id, spiel_id, frage_id, pruefer, sekunden, case when {_LABEL} in ('richtig', 'teilweise', 'falsch', 'unsicher') then {_LABEL} else 'unparsebar' end urteil from u)
"""


def run_metrics(spark, d: str) -> DataFrame:
    return M.run_counts(_verdicts(spark, d), "pruefer")


RUN_SQL = f"""
with {_VERDICTS}, t as (select *, case when sekunden >= 0 then sekunden end s from v)
select pruefer, count(*) n, count(*) filter (urteil = 'richtig') richtig, count(*) filter (urteil = 'teilweise') teilweise, count(*) filter (urteil = 'falsch') falsch,
 count(*) filter (urteil = 'unsicher') unsicher, count(*) filter (urteil = 'unparsebar') unparsebar, round(median(s), 6) median_s, max(s) max_s,
 round(count(*) filter (urteil = 'richtig') / nullif(cast(count(*) - count(*) filter (urteil = 'unsicher') as double), 0), 6) treffsicherheit from t group by 1
"""


def confusion_matrix(spark, d: str) -> DataFrame:
    """First against last verdict on every question, as label and verdict."""
    v = _verdicts(spark, d).where("spiel_id is not null")
    ends = v.groupBy("spiel_id", "frage_id").agg(F.min_by("urteil", "urteil_id").alias("label"), F.max_by("urteil", "urteil_id").alias("urteil"))
    return M.confusion(ends)


CONFUSION_SQL = f"""
with {_VERDICTS}, e as (select arg_min(urteil, urteil_id) label, arg_max(urteil, urteil_id) urteil from v where spiel_id is not null group by spiel_id, frage_id),
l as (select unnest(['richtig', 'teilweise', 'falsch', 'unsicher']) label)
select l.label, count(*) filter (urteil = 'richtig') richtig, count(*) filter (urteil = 'teilweise') teilweise, count(*) filter (urteil = 'falsch') falsch,
 count(*) filter (urteil = 'unsicher') unsicher, count(*) filter (urteil = 'unparsebar') unparsebar from l left join e on e.label = l.label group by 1
"""


def stable_questions(spark, d: str) -> DataFrame:
    return M.stable(_verdicts(spark, d).where("spiel_id is not null"), ["spiel_id", "frage_id"])


STABLE_SQL = f"with {_VERDICTS} select spiel_id, frage_id, min(urteil) urteil, count(*) n from v where spiel_id is not null group by 1, 2 having min(urteil) = max(urteil) and count(*) >= 2"


def directional_change(spark, d: str) -> DataFrame:
    v = _verdicts(spark, d).where("spiel_id is not null")
    even = F.substring("pruefer", -1, 1).cast("int") % 2 == 0
    return M.directions(v.where(even), v.where(~even), ["spiel_id", "frage_id"])


DIRECTION_SQL = f"""
with {_VERDICTS}, r as (select spiel_id, frage_id, cast(right(pruefer, 1) as int) % 2 odd, case urteil when 'falsch' then 0 when 'unsicher' then 1 when 'teilweise' then 2 when 'richtig' then 3 end s from v where spiel_id is not null),
g as (select spiel_id, frage_id, odd, min(s) lo, max(s) hi from r group by 1, 2, 3 having count(s) = count(*) and count(*) >= 2),
j as (select b.spiel_id, b.frage_id, case when o.lo > b.hi then 'verbessert' when o.hi < b.lo then 'verschlechtert' end richtung from g b join g o on b.spiel_id = o.spiel_id and b.frage_id = o.frage_id and b.odd = 0 and o.odd = 1)
select * from j where richtung is not null
"""


def _confident(spark, d: str) -> DataFrame:
    s = _scored(spark, d).where("kategorie in ('getroffen', 'verfehlt')")
    top = F.array_max(F.filter("scores", lambda x: x.isNotNull() & ~F.isnan(x)))
    return s.select(top.alias("p"), (F.col("kategorie") == "getroffen").alias("ok")).where("p is not null")


_CONF = f"{_SCORED}, c as (select list_max(list_filter(x.scores, lambda y: y is not null and not isnan(y))) p, s.kategorie = 'getroffen' ok from s join (select antwort_id, any_value(scores) scores from antworten group by 1) x using (antwort_id) where kategorie in ('getroffen', 'verfehlt')), f as (select * from c where p is not null)"


def calibration_bins(spark, d: str) -> DataFrame:
    return M.confidence_bins(_confident(spark, d), "p", "ok")


CALIBRATION_SQL = f"""
with {_CONF}, e as (select * from (values (0, 0.0, 0.5), (1, 0.5, 0.7), (2, 0.7, 0.9), (3, 0.9, 0.97), (4, 0.97, 1.0001)) t(bin, von, bis))
select cast(e.bin as int) bin, cast(e.von as double) von, cast(e.bis as double) bis, count(p) n, count(*) filter (ok) treffer, round(count(*) filter (ok) / nullif(cast(count(p) as double), 0), 6) quote
from e left join f on f.p >= cast(e.von as double) and f.p < cast(e.bis as double) group by 1, 2, 3
"""


def threshold_curve(spark, d: str) -> DataFrame:
    return M.threshold_curve(_confident(spark, d), "p", "ok")


THRESHOLD_SQL = f"""
with {_CONF}, t as (select cast(unnest([0.7, 0.8, 0.9, 0.95]) as double) schwelle)
select schwelle, count(*) n, count(*) filter (p < schwelle) eskaliert, count(*) filter (p >= schwelle and not ok) fehler, count(*) filter (p >= schwelle) darueber from t, f group by 1
"""


def worst_game(spark, d: str) -> DataFrame:
    return M.worst(M.hit_counts(_scored(spark, d), "spiel_id"), "spiel_id", "verfehlt", "nenner")


WORST_SQL = f"""
with {_SCORED}, g as (select spiel_id gruppe, count(*) filter (kategorie = 'verfehlt') zaehler, count(*) filter (kategorie in ('getroffen', 'verfehlt')) nenner from s group by 1)
select gruppe, zaehler, nenner from g where nenner > 0 order by zaehler / cast(nenner as double) desc, gruppe desc limit 1
"""


def keyword_hits(spark, d: str) -> DataFrame:
    s = _scored(spark, d).where("keywords is not null and antwort is not null")
    return s.select("antwort_id", F.size(T.keyword_hits(F.col("antwort"), F.col("keywords"))).alias("treffer"), F.size("keywords").alias("von"))


_SIGN = r"[\p{L}\p{N}\p{M}_]"
#: Whether a text (first) has a keyword (second): at one of the places where it is split by it, the signs on both sides let it stand.
_HAS = rf"""len(list_filter(range(1, len(string_split(lower({{0}}), lower({{1}})))), lambda i: (not regexp_matches({{1}}, '^{_SIGN.replace('{', '{{').replace('}', '}}')}') or not regexp_matches(string_split(lower({{0}}), lower({{1}}))[i], '{_SIGN.replace('{', '{{').replace('}', '}}')}$'))
  and case when regexp_matches({{1}}, '\s') and regexp_matches({{1}}, '\p{{{{L}}}}$') then regexp_matches(string_split(lower({{0}}), lower({{1}}))[i + 1], '^\p{{{{L}}}}{{{{0,3}}}}([^\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_]|$)')
  when regexp_matches({{1}}, '{_SIGN.replace('{', '{{').replace('}', '}}')}$') then not regexp_matches(string_split(lower({{0}}), lower({{1}}))[i + 1], '^{_SIGN.replace('{', '{{').replace('}', '}}')}') else true end)) > 0"""
KEYWORD_HITS_SQL = f"""
with {_SCORED}, k as (select s.antwort_id, s.antwort, g.keywords, list_transform(list_filter(g.keywords, lambda x: x is not null and trim(x) <> ''), lambda x: trim(x)) k
  from s join golden_set g on g.spiel_id = s.spiel_id and g.frage_id = s.frage_id where g.keywords is not null and s.antwort is not null)
select antwort_id, cast(len(list_filter(k, lambda x: {_HAS.format('antwort', 'x')})) as int) treffer, cast(len(keywords) as int) von from k
"""


def name_keys(spark, d: str) -> DataFrame:
    return table(spark, d, "spiele").select("spiel_id", T.name_key(F.col("spiel_name")).alias("schluessel"))


NAME_SQL = r"select spiel_id, regexp_replace(replace(lower(spiel_name), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') schluessel from spiele"


def slug_names(spark, d: str) -> DataFrame:
    return table(spark, d, "spiele").select("spiel_id", T.slug(F.col("spiel_name")).alias("slug"))


SLUG_SQL = r"""
select spiel_id, trim(regexp_replace(strip_accents(replace(replace(replace(replace(lower(spiel_name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') slug from spiele
"""


def resolve_names(spark, d: str) -> DataFrame:
    """Aliases to games by equal key: one game, or how many share the key."""
    s = table(spark, d, "spiele")
    keys = s.select("spiel_id", F.explode(F.array_append(F.coalesce("aliase", F.array().cast("array<string>")), F.col("spiel_name"))).alias("n"))
    k = keys.select("spiel_id", T.name_key(F.col("n")).alias("schluessel")).where("schluessel <> ''").distinct()
    return k.groupBy("schluessel").agg(F.count(F.lit(1)).alias("spiele"), F.min("spiel_id").alias("erstes"))


RESOLVE_SQL = r"""
with a as (select spiel_id, unnest(list_append(coalesce(aliase, []), spiel_name)) n from spiele),
k as (select distinct spiel_id, regexp_replace(replace(lower(n), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') schluessel from a where n is not null)
select schluessel, count(*) spiele, min(spiel_id) erstes from k where schluessel <> '' group by 1
"""


#: Fixed value: the end of a line of a table of contents.
DIRECTORY_LINE = r"(\.{3,}|…|\s)\s*\d{1,3}\s*$"


def directory_share(spark, d: str) -> DataFrame:
    """Share of lines that look like a table of contents, of every chunk that has any."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    like = F.filter(lines, lambda x: x.rlike(DIRECTORY_LINE))
    return table(spark, d, "chunks").where("text is not null").select("id", F.round(F.try_divide(F.size(like), F.size(lines)), 2).alias("anteil")).where("anteil > 0")


DIRECTORY_SQL = rf"""
with l as (select id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') l from chunks where text is not null),
s as (select id, round(len(list_filter(l, lambda x: regexp_matches(x, '{DIRECTORY_LINE}'))) / nullif(cast(len(l) as double), 0), 2) anteil from l)
select * from s where anteil > 0
"""


def directory_hits(spark, d: str) -> DataFrame:
    """Per game the retrieved chunks of all answers, and how many of them are of a page read by vision or look like a table of contents."""
    c = table(spark, d, "chunks").where("spiel_id is not null")
    seen = c.where("route = 'vision'").select("spiel_id", "seite").distinct().withColumn("vision", F.lit(True))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    share = F.coalesce(F.round(F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(DIRECTORY_LINE))), F.size(lines)), 2), F.lit(0.0))
    c = c.select("id", "spiel_id", "seite", (share >= 0.5).alias("verzeichnis")).join(seen, ["spiel_id", "seite"], "left")
    a = table(spark, d, "antworten").where("antwort_id is not null").dropDuplicates(["antwort_id"]).select(F.explode("abgerufen_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return a.join(c, "id").groupBy("spiel_id").agg(F.sum("n").alias("treffer"), F.sum(F.when(F.col("vision"), F.col("n")).otherwise(0)).alias("vision"), F.sum(F.when(F.col("verzeichnis"), F.col("n")).otherwise(0)).alias("verzeichnis"))


DIRECTORY_HITS_SQL = rf"""
with l as (select id, spiel_id, seite, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') l from chunks where spiel_id is not null),
s as (select id, spiel_id, seite, coalesce(round(len(list_filter(l, lambda x: regexp_matches(x, '{DIRECTORY_LINE}'))) / nullif(cast(len(l) as double), 0), 2), 0) >= 0.5 vz from l),
v as (select distinct spiel_id, seite from chunks where route = 'vision'),
a as (select antwort_id, any_value(abgerufen_id) i from antworten where antwort_id is not null group by 1), h as (select unnest(i) id from a)
select s.spiel_id, count(*) treffer, count(v.spiel_id) vision, count(*) filter (vz) verzeichnis from h join s using (id) left join v on v.spiel_id = s.spiel_id and v.seite = s.seite group by 1
"""


def _sql(cols: str, by: str) -> str:
    return f"with {_SCORED} select {by}, {cols} from s group by {by}"


QUERIES = {
    "eval_category": eval_category, "eval_summary": eval_summary, "eval_by_type": eval_by_type, "hit_rate_by_game": hit_rate_by_game, "precision_mrr": precision_mrr,
    "golden_missing": golden_missing, "run_metrics": run_metrics, "confusion_matrix": confusion_matrix, "stable_questions": stable_questions, "directional_change": directional_change,
    "calibration_bins": calibration_bins, "threshold_curve": threshold_curve, "worst_game": worst_game, "keyword_hits": keyword_hits, "name_keys": name_keys,
    "slug_names": slug_names, "resolve_names": resolve_names, "directory_share": directory_share, "directory_hits": directory_hits,
}
SQL = {
    "eval_category": f"with {_SCORED} select antwort_id, kategorie from s", "eval_summary": _sql(_COUNTS, "setting"), "eval_by_type": _sql(_COUNTS, "setting, fragetyp"),
    "hit_rate_by_game": _sql(_COUNTS, "spiel_id"), "precision_mrr": PRECISION_SQL, "golden_missing": MISSING_SQL, "run_metrics": RUN_SQL, "confusion_matrix": CONFUSION_SQL,
    "stable_questions": STABLE_SQL, "directional_change": DIRECTION_SQL, "calibration_bins": CALIBRATION_SQL, "threshold_curve": THRESHOLD_SQL, "worst_game": WORST_SQL,
    "name_keys": NAME_SQL, "slug_names": SLUG_SQL, "resolve_names": RESOLVE_SQL, "directory_share": DIRECTORY_SQL, "directory_hits": DIRECTORY_HITS_SQL, "keyword_hits": KEYWORD_HITS_SQL,
}
