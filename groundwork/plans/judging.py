"""Named queries over verdicts, runs and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import judging as J
from groundwork.operators import measuring as M
from groundwork.plans.measurement import _HAS, _SCORED, _VERDICTS, _scored, _verdicts
from groundwork.session import table


def _judged(spark, d: str) -> DataFrame:
    """Every verdict with the first one on its question as label, a kind of error and marks by its id, and numbers of tokens."""
    v = _verdicts(spark, d).where("spiel_id is not null")
    first = v.groupBy("spiel_id", "frage_id").agg(F.min_by("urteil", "urteil_id").alias("label"))
    text = table(spark, d, "urteile").groupBy("urteil_id").agg(F.first(F.length("begruendung")).alias("laenge"))
    i = F.col("urteil_id")
    j = v.join(first, ["spiel_id", "frage_id"]).where("label <> 'unparsebar'").join(text, "urteil_id")
    return j.select(
        "urteil_id", "spiel_id", "frage_id", "pruefer", "urteil", "label", "sekunden", F.when(i % 3 > 0, F.concat(F.lit("art"), (i % 3).cast("string"))).alias("fehlerart"), (i % 7 == 0).alias("strittig"),
        (i % 11 == 0).alias("deterministisch"), (100 + F.col("laenge")).alias("eingabe"), F.when(i % 5 > 0, 10 + i % 17).alias("ausgabe"),
    )


_JUDGED = f"""
{_VERDICTS}, fi as (select spiel_id, frage_id, arg_min(urteil, urteil_id) label from v where spiel_id is not null group by 1, 2),
tx as (select urteil_id, any_value(length(begruendung)) laenge from urteile group by 1),
j as (select v.*, label, case when urteil_id % 3 > 0 then 'art' || (urteil_id % 3) end fehlerart, urteil_id % 7 = 0 strittig, urteil_id % 11 = 0 deterministisch,
  100 + laenge eingabe, case when urteil_id % 5 > 0 then 10 + urteil_id % 17 end ausgabe
  from v join fi on fi.spiel_id = v.spiel_id and fi.frage_id = v.frage_id join tx using (urteil_id) where label <> 'unparsebar')
"""


def rate_blocks(spark, d: str) -> DataFrame:
    return J.rate_blocks(_judged(spark, d).where("not strittig"))


BLOCKS_SQL = f"""
with {_JUDGED}, b as (select 'durchgewunken' block, urteil = 'richtig' hit, fehlerart, spiel_id from j where label = 'falsch' and not strittig
  union all select 'abgelehnt', urteil = 'falsch', fehlerart, spiel_id from j where label = 'richtig' and not strittig
  union all select 'falsch_nicht_erkannt', urteil <> 'falsch', fehlerart, spiel_id from j where label = 'falsch' and not strittig
  union all select 'richtig_nicht_erkannt', urteil <> 'richtig', fehlerart, spiel_id from j where label = 'richtig' and not strittig),
g as (select block, 'gesamt' ebene, '' gruppe, hit from b union all select block, 'fehlerart', coalesce(fehlerart, '-'), hit from b union all select block, 'spiel', spiel_id, hit from b)
select block, ebene, gruppe, count(*) filter (hit) zaehler, count(*) nenner, round(count(*) filter (hit) / cast(count(*) as double), 6) quote from g group by 1, 2, 3
"""


def unsure_split(spark, d: str) -> DataFrame:
    return J.unsure_split(_judged(spark, d))


UNSURE_SQL = f"""
with {_JUDGED}, n(name, l, u) as (values ('unsicher_als_falsch', 'unsicher', 'falsch'), ('unsicher_als_richtig', 'unsicher', 'richtig'), ('falsch_als_unsicher', 'falsch', 'unsicher'), ('richtig_als_unsicher', 'richtig', 'unsicher'))
select name, count(*) filter (urteil = u) zaehler, count(label) nenner, round(count(*) filter (urteil = u) / nullif(cast(count(label) as double), 0), 6) quote from n left join j on label = l group by 1
"""


def disputed_split(spark, d: str) -> DataFrame:
    return J.disputed_split(_judged(spark, d))


DISPUTED_SQL = f"""
with {_JUDGED}, c as (select count(*) filter (not strittig) haupt, count(*) filter (strittig) strittig, count(*) filter (not strittig and urteil = 'unparsebar') unparsebar, count(*) filter (deterministisch) deterministisch, count(*) alle from j)
select *, round(unparsebar / nullif(cast(haupt as double), 0), 6) quote_unparsebar, round(deterministisch / nullif(cast(alle as double), 0), 6) quote_deterministisch from c
"""


def latency_median_max(spark, d: str) -> DataFrame:
    return J.latency(_judged(spark, d), "pruefer")


LATENCY_SQL = f'with {_JUDGED} select pruefer, count(*) n, round(median(sekunden), 6) "median", max(sekunden) "max" from j where sekunden is not null and not deterministisch group by 1'


def token_cost(spark, d: str) -> DataFrame:
    return J.token_cost(_judged(spark, d), 1.0, 5.0, "pruefer")


TOKEN_SQL = f"""
with {_JUDGED}, t as (select *, (eingabe * 1.0::double + ausgabe * 5.0::double) / 1e6 k from j where eingabe is not null and ausgabe is not null and not deterministisch)
select pruefer, count(*) n, cast(sum(eingabe) as bigint) eingabe_summe, round(median(eingabe), 6) eingabe_typisch, max(eingabe) eingabe_max, cast(sum(ausgabe) as bigint) ausgabe_summe,
 round(median(ausgabe), 6) ausgabe_typisch, max(ausgabe) ausgabe_max, round(sum(k), 6) kosten_summe, round(median(k), 6) kosten_typisch, round(max(k), 6) kosten_max from t group by 1
"""


def label_overrides(spark, d: str) -> DataFrame:
    """Labels of every thirteenth verdict replaced, and what that makes of labels and kinds of error."""
    rows = _judged(spark, d).withColumn("zeile", F.col("urteil_id"))
    o = rows.where("urteil_id % 13 = 0").select("zeile", F.when(F.col("urteil_id") % 2 == 0, "falsch").otherwise("richtig").alias("neu"), F.when(F.col("urteil_id") % 26 == 0, "genannt").alias("fehlerart"))
    return J.with_overrides(rows, o).groupBy("label", "label_original", "override", "fehlerart").agg(F.count(F.lit(1)).alias("n"))


OVERRIDE_SQL = f"""
with {_JUDGED}, o as (select *, urteil_id % 13 = 0 ov, case when urteil_id % 2 = 0 then 'falsch' else 'richtig' end neu from j)
select case when ov then neu else label end "label", case when ov then label end label_original, ov "override",
 case when not ov then fehlerart when urteil_id % 26 = 0 then 'genannt' when neu = 'falsch' then fehlerart end fehlerart, count(*) n from o group by 1, 2, 3, 4
"""


def _runs(spark, d: str) -> DataFrame:
    """Verdicts as runs: a judge's last digit is the setting, the id's rest by three the repetition."""
    v = _verdicts(spark, d).where("spiel_id is not null")
    return v.withColumn("setting", F.substring("pruefer", -1, 1)).withColumn("lauf", (F.col("urteil_id") % 3).cast("int"))


_RUNS = f"{_VERDICTS}, ru as (select *, right(pruefer, 1) setting, cast(urteil_id % 3 as int) lauf, case when sekunden >= 0 then sekunden end t from v where spiel_id is not null)"


def setting_minmax(spark, d: str) -> DataFrame:
    return J.setting_span(_runs(spark, d), "setting", "lauf")


SETTING_SQL = f"""
with {_RUNS}, p as (select setting, lauf, count(*) filter (urteil = 'richtig') / nullif(cast(count(*) filter (urteil <> 'unsicher') as double), 0) q from ru group by 1, 2),
s as (select setting, count(*) laeufe, round(min(q), 6) treffsicherheit_min, round(max(q), 6) treffsicherheit_max from p group by 1),
z as (select setting, round(median(t), 6) median_s, max(t) max_s from ru group by 1) select * from s join z using (setting)
"""


def run_by_type(spark, d: str) -> DataFrame:
    g = table(spark, d, "golden_set").select("spiel_id", "frage_id", "typ")
    return M.run_counts(_runs(spark, d).join(g, ["spiel_id", "frage_id"]), "setting", "typ", "lauf")


BY_TYPE_SQL = f"""
with {_RUNS}, g as (select ru.*, g.typ from ru join golden_set g on g.spiel_id = ru.spiel_id and g.frage_id = ru.frage_id)
select setting, typ, lauf, count(*) n, count(*) filter (urteil = 'richtig') richtig, count(*) filter (urteil = 'teilweise') teilweise, count(*) filter (urteil = 'falsch') falsch,
 count(*) filter (urteil = 'unsicher') unsicher, count(*) filter (urteil = 'unparsebar') unparsebar, round(median(t), 6) median_s, max(t) max_s,
 round(count(*) filter (urteil = 'richtig') / nullif(cast(count(*) - count(*) filter (urteil = 'unsicher') as double), 0), 6) treffsicherheit from g group by 1, 2, 3
"""


def unequal_runs(spark, d: str) -> DataFrame:
    """Questions that some repetitions of a setting lack."""
    return J.unequal_runs(_runs(spark, d), "setting", "lauf", ["spiel_id", "frage_id"])


UNEQUAL_SQL = f"""
with {_RUNS}, q as (select distinct setting, spiel_id, frage_id from ru), l as (select distinct setting, lauf from ru), r as (select distinct setting, lauf, spiel_id, frage_id from ru)
select l.setting, l.lauf, count(*) fehlt from q join l using (setting) left join r on r.setting = l.setting and r.lauf = l.lauf and r.spiel_id = q.spiel_id and r.frage_id = q.frage_id where r.lauf is null group by 1, 2
"""

_SPELLINGS = [" A", "a)", "B.", "C", "D:", "x"]


def option_argmax(spark, d: str) -> DataFrame:
    """Options out of probabilities of first tokens that the verdicts' ids stand for."""
    i = F.col("urteil_id")
    tokens = F.array(*[F.struct(F.lit(t).alias("token"), (-((i * (7 + k)) % 13).cast("double") / 4 - 1.5).alias("logprob")) for k, t in enumerate(_SPELLINGS)])
    v = table(spark, d, "urteile").select("urteil_id").distinct().withColumn("t", tokens)
    p = J.option_shares(F.col("t"), J.VERDICT_OPTIONS)
    return v.select("urteil_id", J.best_option(p, J.VERDICT_OPTIONS).alias("urteil"), F.round(F.try_element_at(p, F.lit("richtig")), 6).alias("p_richtig"), F.round(J.option_rest(F.col("t"), J.VERDICT_OPTIONS), 6).alias("rest"))


_LOG = ", ".join(f"exp(-((urteil_id * {7 + k}) % 13)::double / 4 - 1.5) e{k}" for k in range(6))
OPTION_SQL = f"""
with u as (select distinct urteil_id from urteile), e as (select urteil_id, {_LOG} from u), m as (select urteil_id, e0 + e1 a, e2 b, e3 c, e4 d from e)
select urteil_id, case when a >= b and a >= c and a >= d then 'richtig' when b >= c and b >= d then 'teilweise' when c >= d then 'falsch' else 'unsicher' end urteil,
 round(a / (a + b + c + d), 6) p_richtig, round(greatest(0, 1 - (a + b + c + d)), 6) rest from m
"""


def decision_compose(spark, d: str) -> DataFrame:
    """Answers as the decision step composes them, an option in turn for each."""
    a = table(spark, d, "antworten").where("antwort_id is not null and antwort is not null").dropDuplicates(["antwort_id"])
    option = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("antwort_id") % 3 + 1).cast("int"))
    pages = F.array_distinct(F.array_compact(F.coalesce("abgerufen", F.array().cast("array<int>"))))
    return a.select("antwort_id", F.md5(J.composed_answer(option, F.col("antwort"), pages)).alias("hash"))


_DISTINCT = "list_filter(p, lambda x, i: list_position(p, x) = i)"
COMPOSE_SQL = f"""
with a as (select antwort_id, any_value(antwort) t, coalesce(any_value(abgerufen), []) p from antworten where antwort_id is not null group by 1),
l as (select antwort_id, t, array_to_string(list_transform({_DISTINCT}, lambda x: 'S. ' || x), ', ') s from a where t is not null)
select antwort_id, md5(case antwort_id % 3 when 0 then t when 1 then t || chr(10) || chr(10) || '{J.PARTLY}' || case when s <> '' then ' -- pruef ' || s || '.' else '.' end
 else '{J.NOTHING}' || case when s <> '' then ' {J.NEAREST} ' || s || '.' else '' end end) hash from l
"""


def _replied(spark, d: str) -> DataFrame:
    """Answers, some of them made a fixed refusal, or one with more behind it."""
    a = table(spark, d, "antworten").where("antwort_id is not null and antwort is not null").dropDuplicates(["antwort_id"])
    k = F.col("antwort_id") % 5
    text = F.when(k == 0, J.NOT_CLEAR).when(k == 1, F.concat(F.lit(J.NOTHING + "  "), F.lit(J.NEAREST), F.lit(" S. 3, S. 9."))).when(k == 2, F.concat(F.lit(J.NOTHING + " "), F.col("antwort")))
    text = text.when(k == 3, F.concat(F.lit(J.NOT_CLEAR), F.lit(" Schau auf Seite 3 und 4 nach."))).otherwise(F.col("antwort"))
    return a.select("antwort_id", "spiel_id", "frage_id", text.alias("antwort"))


_REPLIED = f"""
a as (select antwort_id, any_value(spiel_id) spiel_id, any_value(frage_id) frage_id, any_value(antwort) t from antworten where antwort_id is not null group by 1),
r as (select antwort_id, spiel_id, frage_id, case antwort_id % 5 when 0 then '{J.NOT_CLEAR}' when 1 then '{J.NOTHING}  {J.NEAREST} S. 3, S. 9.' when 2 then '{J.NOTHING} ' || t when 3 then '{J.NOT_CLEAR} Schau auf Seite 3 und 4 nach.' else t end antwort from a where t is not null)
"""


def refusal_fixed(spark, d: str) -> DataFrame:
    g = table(spark, d, "golden_set").select("spiel_id", "frage_id", "erwartet_verweigerung")
    j = _replied(spark, d).join(g, ["spiel_id", "frage_id"], "left")
    return j.select("antwort_id", J.deterministic_verdict(F.col("antwort"), F.col("erwartet_verweigerung")).alias("urteil")).where("urteil is not null")


REFUSAL_SQL = rf"""
with {_REPLIED}, n as (select r.*, replace(replace(replace(replace(lower(trim(regexp_replace(antwort, '\s+', ' ', 'g'))), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') t from r)
select antwort_id, case when coalesce(erwartet_verweigerung, false) then 'richtig' else 'unsicher' end urteil from n left join golden_set g on g.spiel_id = n.spiel_id and g.frage_id = n.frage_id
where regexp_matches(t, '^(in den gefundenen stellen steht das nicht eindeutig\.(\s+schau auf seite\s+\d+((\s*,\s*|\s+und\s+)\d+)*\s+nach\.)?|in den gefundenen stellen steht dazu nichts\.)(\s+naechste fundstellen:\s+(s\.\s*\d+(\s*,\s*s\.\s*\d+)*|seite\s+\d+((\s*,\s*|\s+und\s+)seite\s+\d+)*)\.?)?$')
"""


def verdict_parse(spark, d: str) -> DataFrame:
    """Replies of judges with a reasoning block, an earlier and a last verdict."""
    u = table(spark, d, "urteile").dropDuplicates(["urteil_id"]).where("urteil is not null and begruendung is not null")
    reply = F.concat(F.lit("<think>URTEIL: falsch</think>"), F.col("begruendung"), F.lit("\nUrteil: teilweise\nURTEIL: **"), F.col("urteil"), F.lit("**"))
    return u.select("urteil_id", T.last_verdict(reply).alias("urteil"))


PARSE_SQL = r"""
with u as (select urteil_id, any_value(urteil) u, any_value(begruendung) b from urteile group by 1),
r as (select urteil_id, lower(regexp_extract_all(b || chr(10) || 'Urteil: teilweise' || chr(10) || 'URTEIL: **' || u || '**', '(?i)URTEIL\s*[:=]\s*[*_`"''\s]*([A-Za-zÄÖÜäöüß]+)', 1)[-1]) w from u where u is not null and b is not null)
select urteil_id, case when w in ('richtig', 'teilweise', 'falsch', 'unsicher') then w else 'unparsebar' end urteil from r
"""


def class_cascade(spark, d: str) -> DataFrame:
    """Replies of a classifier in six forms made of the chunks' types."""
    c = table(spark, d, "chunks").where("typ is not null")
    t, k = F.trim("typ"), F.col("id") % 6
    reply = F.when(k == 0, t).when(k == 1, F.concat(F.lit("<think>flavor?</think>"), t)).when(k == 2, F.concat(F.lit("Kein Regelinhalt, sondern "), t, F.lit(".")))
    reply = reply.when(k == 3, F.concat(F.lit("Das ist nicht "), t, F.lit(" sondern meta"))).when(k == 4, F.concat(F.lit("Spielregel oder "), t)).otherwise(F.concat(F.lit("Antwort:\n"), F.upper(t), F.lit("\n")))
    return c.select("id", T.class_of_reply(reply).alias("klasse"))


_NEG = "['kein', 'keine', 'keinen', 'keinem', 'keiner', 'keins', 'nicht', 'weder', 'noch', 'statt', 'anstatt', 'ohne']"
_NAMED = f"""(select case when len(f) = 1 and len(list_filter(['regel', 'flavor', 'meta'], lambda c: len(list_filter(w, lambda x: contains(x, c))) > 0)) = 1 then f[1] end from
 (select w, list_filter(['regel', 'flavor', 'meta'], lambda c: list_contains(w, c)) f from (select list_filter(a, lambda x, i: not list_has_any(a[greatest(i - 2, 1):i - 1], {_NEG})) w from (select regexp_extract_all({{0}}, '[a-zäöüß]+') a))))"""
CASCADE_SQL = rf"""
with r as (select id, lower(trim(case id % 6 when 0 then trim(typ) when 1 then '<think>flavor?</think>' || trim(typ) when 2 then 'Kein Regelinhalt, sondern ' || trim(typ) || '.'
  when 3 then 'Das ist nicht ' || trim(typ) || ' sondern meta' when 4 then 'Spielregel oder ' || trim(typ) else 'Antwort:' || chr(10) || upper(trim(typ)) || chr(10) end)) a from chunks where typ is not null),
c as (select id, a, trim(replace(a, '<think>flavor?</think>', ' ')) b from r), l as (select id, a, b, trim(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '')[-1]) z from c)
select id, coalesce(case when a in ('regel', 'flavor', 'meta') then a end, case when z in ('regel', 'flavor', 'meta') then z end, {_NAMED.format('z')}, {_NAMED.format('b')}, 'regel') klasse from l
"""


def _kw(spark, d: str) -> DataFrame:
    s = _scored(spark, d).where("kategorie is not null")
    found = F.coalesce(F.size(T.keyword_hits(F.coalesce("antwort", F.lit("")), F.coalesce("keywords", F.array().cast("array<string>")))), F.lit(0))
    signal = F.when(F.col("kategorie") == "verweigerung", F.coalesce(F.col("antwort").contains("In den gefundenen Stellen steht"), F.lit(False))).otherwise(False)
    return s.select("antwort_id", "setting", "fragetyp", "spiel_id", "frage_id", "kategorie", ((found > 0) | signal).alias("treffer"))


_KW = f"""{_SCORED},
kx as (select s.antwort_id, s.setting, s.fragetyp, s.spiel_id, s.frage_id, s.kategorie, coalesce(s.antwort, '') antwort, list_transform(list_filter(coalesce(g.keywords, []), lambda x: x is not null and trim(x) <> ''), lambda x: trim(x)) k
  from s join golden_set g on g.spiel_id = s.spiel_id and g.frage_id = s.frage_id where s.kategorie is not null),
kt as (select * exclude (k, antwort), len(list_filter(k, lambda x: {_HAS.format('antwort', 'x')})) n, kategorie = 'verweigerung' and contains(antwort, 'In den gefundenen Stellen steht') sig from kx),
kw as (select *, n > 0 or sig treffer from kt)"""


def eval_totals(spark, d: str) -> DataFrame:
    """Per setting all counts of a summary: hits and misses, refusals and their signals, keyword hits."""
    c = F.col("kategorie")
    return _kw(spark, d).groupBy("setting").agg(
        F.count(F.lit(1)).alias("fragen"), F.count_if(c.isin("getroffen", "verfehlt")).alias("nenner"), F.count_if(c == "getroffen").alias("getroffen"), F.count_if(c == "verfehlt").alias("verfehlt"),
        F.count_if(c == "verweigerung").alias("verweigerungsfragen"), F.count_if((c == "verweigerung") & F.col("treffer")).alias("verweigerung_signal"), F.count_if("treffer").alias("kw_treffer"),
    )


TOTALS_SQL = f"""
with {_KW} select setting, count(*) fragen, count(*) filter (kategorie in ('getroffen', 'verfehlt')) nenner, count(*) filter (kategorie = 'getroffen') getroffen, count(*) filter (kategorie = 'verfehlt') verfehlt,
 count(*) filter (kategorie = 'verweigerung') verweigerungsfragen, count(*) filter (kategorie = 'verweigerung' and treffer) verweigerung_signal, count(*) filter (treffer) kw_treffer from kw group by 1
"""


def hit_rate_sets(spark, d: str) -> DataFrame:
    """Hit rate by game, by type and in all, each with its number of missed questions."""
    s = _scored(spark, d).where("kategorie in ('getroffen', 'verfehlt')").withColumn("fragetyp", F.coalesce("fragetyp", F.lit("-")))
    s.createOrReplaceTempView("gw_scored")
    g = spark.sql("""select spiel_id, fragetyp, count(*) nenner, count_if(kategorie = 'getroffen') getroffen, count(distinct case when kategorie = 'verfehlt' then concat_ws('#', spiel_id, frage_id) end) verfehlte_fragen
      from gw_scored group by grouping sets ((spiel_id), (fragetyp), ())""")
    return g.withColumn("quote", F.round(M.rate(F.col("getroffen"), F.col("nenner")), 6))


SETS_SQL = f"""
with {_SCORED}, t as (select *, coalesce(fragetyp, '-') ft from s where kategorie in ('getroffen', 'verfehlt')),
g as (select spiel_id, ft fragetyp, count(*) nenner, count(*) filter (kategorie = 'getroffen') getroffen, count(distinct case when kategorie = 'verfehlt' then spiel_id || '#' || frage_id end) verfehlte_fragen from t group by grouping sets ((spiel_id), (ft), ()))
select *, round(getroffen / nullif(cast(nenner as double), 0), 6) quote from g
"""


def class_counts(spark, d: str) -> DataFrame:
    """Classes of the chunks' types, and how many were no bare class."""
    t = table(spark, d, "chunks").where("typ is not null").select("typ", T.class_of_reply(F.col("typ")).alias("klasse"))
    return t.groupBy("klasse").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("typ").isin("regel", "flavor", "meta")).alias("gedeutet"))


CLASS_SQL = f"""
with r as (select typ, lower(trim(typ)) z from chunks where typ is not null),
k as (select typ, coalesce(case when z in ('regel', 'flavor', 'meta') then z end, {_NAMED.format('z')}, 'regel') klasse from r)
select klasse, count(*) n, count(*) filter (typ not in ('regel', 'flavor', 'meta')) gedeutet from k group by 1
"""

QUERIES = {
    "rate_blocks": rate_blocks, "unsure_split": unsure_split, "disputed_split": disputed_split, "latency_median_max": latency_median_max, "token_cost": token_cost, "label_overrides": label_overrides,
    "setting_minmax": setting_minmax, "run_by_type": run_by_type, "unequal_runs": unequal_runs, "option_argmax": option_argmax, "decision_compose": decision_compose, "refusal_fixed": refusal_fixed,
    "verdict_parse": verdict_parse, "class_cascade": class_cascade, "eval_totals": eval_totals, "hit_rate_sets": hit_rate_sets, "class_counts": class_counts,
}
SQL = {
    "rate_blocks": BLOCKS_SQL, "unsure_split": UNSURE_SQL, "disputed_split": DISPUTED_SQL, "latency_median_max": LATENCY_SQL, "token_cost": TOKEN_SQL, "label_overrides": OVERRIDE_SQL,
    "setting_minmax": SETTING_SQL, "run_by_type": BY_TYPE_SQL, "unequal_runs": UNEQUAL_SQL, "option_argmax": OPTION_SQL, "decision_compose": COMPOSE_SQL, "refusal_fixed": REFUSAL_SQL,
    "verdict_parse": PARSE_SQL, "class_cascade": CASCADE_SQL, "eval_totals": TOTALS_SQL, "hit_rate_sets": SETS_SQL, "class_counts": CLASS_SQL,
}
