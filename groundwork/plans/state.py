"""Named queries about the state of an index, chats, and page layouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import chat as H
from groundwork.operators import index as I
from groundwork.operators import layout as L
from groundwork.session import table

#: Rows before this day are the stored snapshot; games up to this letter are declared now.
DAY, FROM = "2024-11-15", "f"


def _stored(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.col("spiel_id").isNotNull() & (F.col("erstellt") < F.to_timestamp(F.lit(DAY))))


def _declared(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").where((F.col("spiel_id") >= FROM) & ((F.col("erstellt") < F.to_timestamp(F.lit(DAY))) | (F.col("id") % 50 == 0)))


_SNAPSHOTS = f"""
st as (select * from chunks where spiel_id is not null and erstellt < timestamp '{DAY}'),
de as (select * from chunks where spiel_id >= '{FROM}' and (erstellt < timestamp '{DAY}' or id % 50 = 0))
"""


def _hashed(source: str, by: str) -> str:
    """SQL of the bucketed fingerprint of a table of chunks, by some columns."""
    return f"""(select {by}, cast(sum(n) as bigint) n_chunks, sha256(string_agg(h, '' order by b)) fingerprint from
 (select {by}, floor(id / 4096) b, count(*) n, sha256(string_agg(h, '' order by id)) h from (select *, sha256(concat(id, chr(10), coalesce(text, ''))) h from {source}) group by all) group by {by})"""


def fingerprints(spark, d: str) -> DataFrame:
    return I.fingerprints(table(spark, d, "chunks").where("spiel_id is not null"), "spiel_id", "id", "text")


FINGER_SQL = f"with c as (select * from chunks where spiel_id is not null) select * from {_hashed('c', 'spiel_id')}"


def index_status(spark, d: str) -> DataFrame:
    """Games as declared now against the stored snapshot."""
    now = I.fingerprints(_declared(spark, d), "spiel_id", "id", "text")
    return I.status(now, I.fingerprints(_stored(spark, d), "spiel_id", "id", "text"), "spiel_id")


STATUS_SQL = f"""
with {_SNAPSHOTS}, n as (select * from {_hashed('de', 'spiel_id')}), o as (select * from {_hashed('st', 'spiel_id')})
select coalesce(n.spiel_id, o.spiel_id) spiel_id, case when o.fingerprint is null then 'neu' when n.fingerprint is null then 'entfernt' when n.fingerprint = o.fingerprint then 'aktuell' else 'geaendert' end status
from n full join o on n.spiel_id = o.spiel_id
"""


def stale_collections(spark, d: str) -> DataFrame:
    now = I.fingerprints(_declared(spark, d), "spiel_id", "id", "text")
    return I.stale(I.fingerprints(_stored(spark, d), "spiel_id", "id", "text"), now, "spiel_id")


STALE_SQL = f"select * from ({STATUS_SQL}) where status <> 'aktuell'"


def index_removed(spark, d: str) -> DataFrame:
    return I.removed(_stored(spark, d), _declared(spark, d), "spiel_id")


REMOVED_SQL = f"with {_SNAPSHOTS} select distinct spiel_id from st where spiel_id not in (select spiel_id from de)"


def dropped_collections(spark, d: str) -> DataFrame:
    """What is left of the stored chunks, by game, once those of gone games are dropped."""
    gone = I.removed(_stored(spark, d), _declared(spark, d), "spiel_id")
    return I.without_collections(_stored(spark, d), gone, "spiel_id").groupBy("spiel_id").agg(F.count(F.lit(1)).alias("n"))


DROPPED_SQL = f"with {_SNAPSHOTS} select spiel_id, count(*) n from st where spiel_id in (select spiel_id from de) group by 1"


def _book_states(spark, d: str, df: DataFrame, edition) -> DataFrame:
    f = I.fingerprints(df.where("buch_id is not null").withColumn("_k", F.concat_ws("/", "spiel_id", "buch_id")), "_k", "id", "text")
    of = df.where("buch_id is not null").groupBy("spiel_id", "buch_id").agg(edition.alias("deklaration")).withColumn("_k", F.concat_ws("/", "spiel_id", "buch_id"))
    return of.join(f, "_k").drop("_k")


def _plan(spark, d: str) -> DataFrame:
    now = _book_states(spark, d, _declared(spark, d), F.concat(F.max("fassung"), F.when(F.max("buch_id") == "faq", "!").otherwise("")))
    return I.book_plan(now, _book_states(spark, d, _stored(spark, d), F.max("fassung")), ["spiel_id", "buch_id"])


def book_steps(spark, d: str) -> DataFrame:
    return _plan(spark, d)


_STEPS = f"""
nf as (select * from {_hashed("(select * from de where buch_id is not null)", 'spiel_id, buch_id')}), sf as (select * from {_hashed("(select * from st where buch_id is not null)", 'spiel_id, buch_id')}),
nd as (select spiel_id, buch_id, max(fassung) || case when buch_id = 'faq' then '!' else '' end dk from de where buch_id is not null group by 1, 2), sd as (select spiel_id, buch_id, max(fassung) dk from st where buch_id is not null group by 1, 2),
n as (select nf.*, nd.dk from nf join nd on nf.spiel_id = nd.spiel_id and nf.buch_id = nd.buch_id), o as (select sf.*, sd.dk from sf join sd on sf.spiel_id = sd.spiel_id and sf.buch_id = sd.buch_id),
pl as (select coalesce(n.spiel_id, o.spiel_id) spiel_id, coalesce(n.buch_id, o.buch_id) buch_id, case when n.fingerprint is null then 'loeschen' when o.fingerprint is null or n.fingerprint <> o.fingerprint then 'einbetten'
  when n.dk is distinct from o.dk then 'umschreiben' else 'behalten' end schritt from n full join o on n.spiel_id = o.spiel_id and n.buch_id = o.buch_id)
"""
STEPS_SQL = f"with {_SNAPSHOTS}, {_STEPS} select * from pl"


def index_refresh(spark, d: str) -> DataFrame:
    """The next snapshot, renumbered by book and old position: its size and last position by game."""
    cols = ["spiel_id", "buch_id", "pos", "id", "text", "emb"]
    new = I.refreshed(_stored(spark, d).select(*cols), _declared(spark, d).select(*cols), _plan(spark, d), ["spiel_id", "buch_id"])
    r = I.renumbered(new, "spiel_id", ["buch_id", "pos"])
    return r.groupBy("spiel_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("letzte"), F.max_by("id", "pos").alias("letzte_id"))


REFRESH_SQL = f"""
with {_SNAPSHOTS}, {_STEPS}, x as (select spiel_id, buch_id, pos, id from st join pl using (spiel_id, buch_id) where schritt = 'behalten'
  union all select spiel_id, buch_id, pos, id from de join pl using (spiel_id, buch_id) where schritt in ('einbetten', 'umschreiben')),
r as (select *, row_number() over (partition by spiel_id order by buch_id, pos) - 1 p from x)
select spiel_id, count(*) n, cast(max(p) as int) letzte, arg_max(id, p) letzte_id from r group by 1
"""


def pos_renumber(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("spiel_id is not null and buch_id is not null").select("id", "spiel_id", "buch_id", F.col("pos").alias("buch_pos"))
    return I.renumbered(c, "spiel_id", ["buch_id", "buch_pos", "id"]).select("id", "pos")


RENUMBER_SQL = "select id, cast(row_number() over (partition by spiel_id order by buch_id, pos, id) - 1 as int) pos from chunks where spiel_id is not null and buch_id is not null"


def replaced_rows(spark, d: str) -> DataFrame:
    """Chunks of one route given again: they take the place of the old ones with the next ids."""
    c = table(spark, d, "chunks").where("route is not null").select("id", "route", "text")
    return I.replaced(c, c.where("route = 'vision' and id % 2 = 0"), "route", "id").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("von"), F.max("id").alias("bis"))


REPLACED_SQL = """
with c as (select * from chunks where route is not null), k as (select * from c where route <> 'vision'),
n as (select 'vision' route, (select max(id) from k) + row_number() over (order by id) id from c where route = 'vision' and id % 2 = 0)
select route, count(*) n, min(id) von, max(id) bis from (select route, id from k union all select route, id from n) group by 1
"""


def collection_hashes(spark, d: str) -> DataFrame:
    """Hashes of games of several books: configuration, declarations and hashes of the books."""
    b = _book_states(spark, d, table(spark, d, "chunks").where("spiel_id is not null"), F.max("fassung"))
    return I.collection_fingerprints(b, "spiel_id", "buch_id", I.config_key("quell-32", 400, 150))


COLLECTION_SQL = f"""
with c as (select * from chunks where spiel_id is not null and buch_id is not null), f as (select * from {_hashed('c', 'spiel_id, buch_id')}), g as (select spiel_id, buch_id, max(fassung) dk from c group by 1, 2),
j as (select f.*, dk from f join g on f.spiel_id = g.spiel_id and f.buch_id = g.buch_id)
select spiel_id, cast(sum(n_chunks) as bigint) n_chunks, sha256('{I.config_key("quell-32", 400, 150)}' || chr(0) || string_agg(buch_id || chr(0) || coalesce(dk, '') || chr(0) || fingerprint, chr(0) order by buch_id)) fingerprint from j group by 1
"""


def snapshot_tags(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("spiel_id is not null and konfig is not null").select("spiel_id", "konfig").distinct()
    return c.select("spiel_id", "konfig", I.snapshot_tag(F.col("spiel_id"), F.col("konfig")).alias("tag"))


TAGS_SQL = "select distinct spiel_id, konfig, sha1(spiel_id || chr(0) || konfig) tag from chunks where spiel_id is not null and konfig is not null"


def config_fields(spark, d: str) -> DataFrame:
    """Configurations out of their JSON, with the number of chunks of each."""
    c = table(spark, d, "chunks").select(F.from_json("konfig", "chunk_size int, overlap int, embed string").alias("k"))
    return c.groupBy("k.chunk_size", "k.overlap", "k.embed").agg(F.count(F.lit(1)).alias("n"))


CONFIG_SQL = """select cast(konfig ->> '$.chunk_size' as int) chunk_size, cast(konfig ->> '$.overlap' as int) "overlap", konfig ->> '$.embed' embed, count(*) n from chunks group by 1, 2, 3"""


def collections_without_golden(spark, d: str) -> DataFrame:
    g = table(spark, d, "golden_set").where("typ = 'tabelle'")
    return table(spark, d, "spiele").select("spiel_id").distinct().join(g, "spiel_id", "left_anti")


NO_GOLDEN_SQL = "select distinct spiel_id from spiele s where not exists (select 1 from golden_set g where g.spiel_id = s.spiel_id and g.typ = 'tabelle')"


def chain_questions(spark, d: str) -> DataFrame:
    """Earlier questions of answers that were asked in a chain, and the prompt's part that names them."""
    a = table(spark, d, "antworten").where("antwort_id is not null and verlauf is not null").dropDuplicates(["antwort_id"])
    e = a.select("antwort_id", T.earlier_questions(F.col("verlauf"), F.col("frage")).alias("v"))
    return e.select("antwort_id", F.size("v").alias("n"), F.md5(T.history_prompt(F.col("v"))).alias("hash"))


CHAIN_SQL = """
with a as (select antwort_id, any_value(verlauf) v, any_value(frage) f from antworten where antwort_id is not null group by 1),
e as (select antwort_id, case when len(v) > 0 and v[len(v)] = f then v[1:len(v) - 1] else v end v from a where v is not null)
select antwort_id, cast(len(v) as int) n, md5(case when len(v) > 0 then 'Bisheriger Gesprächsverlauf (Fragen des Nutzers, älteste zuerst):' || chr(10) || array_to_string(list_transform(v, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) else '' end) hash from e
"""


def _messages(spark, d: str) -> DataFrame:
    """Chats out of answers: earlier questions, each answered with a footer, then the question."""
    a = table(spark, d, "antworten").where("antwort_id is not null and verlauf is not null and frage is not null").dropDuplicates(["antwort_id"])
    v = a.select("antwort_id", "frage", F.posexplode_outer("verlauf").alias("i", "v"))
    foot = "\n\n---\n*Abgerufen: Seite 3, 4*"
    both = F.array(F.struct((2 * F.col("i")).alias("turn"), F.lit("user").alias("role"), F.col("v").alias("text")), F.struct((2 * F.col("i") + 1).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("Zu "), F.col("v"), F.lit(foot)).alias("text")))
    talk = v.where("v is not null").select("antwort_id", F.explode(both).alias("m")).select(F.col("antwort_id").alias("conv_id"), "m.*")
    last = a.select(F.col("antwort_id").alias("conv_id"), F.lit(1000).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("  "), F.col("frage")).alias("text"))
    return talk.unionByName(last).unionByName(a.select(F.col("antwort_id").alias("conv_id"), F.lit(-1).alias("turn"), F.lit("system").alias("role"), F.lit("Regeln").alias("text")))


def history_split(spark, d: str) -> DataFrame:
    s = H.split_history(_messages(spark, d))
    return s.select("conv_id", F.md5("frage").alias("frage"), F.size("verlauf").alias("n"), F.md5(F.array_join(F.transform("verlauf", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")).alias("hash"))


SPLIT_SQL = """
with a as (select antwort_id, any_value(verlauf) v, any_value(frage) f from antworten where antwort_id is not null group by 1),
b as (select antwort_id, f, list_filter(v, lambda x: x is not null) v from a where v is not null and f is not null)
select antwort_id conv_id, md5(trim('  ' || f)) frage, cast(2 * len(v) as int) n, md5(array_to_string(list_transform(v, lambda x: 'user:' || x || '|assistant:Zu ' || x), '|')) hash from b
"""


def chat_choice(spark, d: str) -> DataFrame:
    """The game every chat is about: three messages, of which every third chat names a game and every ninth one that is none."""
    a = table(spark, d, "antworten").where("antwort_id is not null and frage is not null and spiel_id is not null").dropDuplicates(["antwort_id"])
    s = table(spark, d, "spiele").dropDuplicates(["spiel_id"])
    j = a.select("antwort_id", "spiel_id", "frage").join(s.select("spiel_id", "spiel_name"), "spiel_id").withColumn("k", F.col("antwort_id") % 9)
    first = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Spiel: "), F.when(F.col("k") == 0, "Unbekanntes").otherwise(F.col("spiel_name")))).otherwise(F.col("frage"))
    rows = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), first.alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("k") == 1, H.ASKS).otherwise("Gut.").alias("text")),
                   F.struct(F.lit(2).alias("turn"), F.lit("user").alias("role"), F.when(F.col("k") == 1, F.concat(F.lit("für "), F.col("spiel_name"), F.lit(" bitte"))).otherwise(F.concat(F.lit("Frage "), F.col("frage"))).alias("text")))
    m = j.select(F.col("antwort_id").alias("conv_id"), F.explode(rows).alias("m")).select("conv_id", "m.*")
    forms = s.select(F.col("spiel_name").alias("name"), F.explode(F.array_append(F.coalesce("aliase", F.array().cast("array<string>")), F.col("spiel_name"))).alias("form"))
    return H.decide_chats(m, forms).select(F.col("conv_id").cast("bigint").alias("conv_id"), "art", F.array_join("namen", "; ").alias("namen"), "turn", "frage")


def _lines(spark, d: str) -> DataFrame:
    """Lines of the chunks with places on a page of 800 points, fonts and classes by their number."""
    c = table(spark, d, "chunks").where("text is not null")
    x = c.select(F.col("id").alias("doc_id"), F.coalesce("seite", F.lit(0)).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    n = F.col("line_no")
    font = F.struct(F.when(n % 4 == 0, 14.0).otherwise(10.0).alias("groesse"), (n % 2 == 0).alias("fett"), F.lit(False).alias("kursiv"), F.lit(False).alias("kapitaelchen"), F.lit(0.1).alias("laufweite"))
    return x.withColumn("cls", F.when(n % 7 == 3, "table").when(n % 5 == 4, "section_header").otherwise("text")).withColumn("top", F.when(n % 11 < 10, (n * 20 % 790).cast("double"))).withColumn("bottom", F.col("top") + 12).withColumn("page_h", F.lit(800.0)).withColumn("font", F.when(n % 3 > 0, font))


_LINES = """
ls as (select id doc_id, coalesce(seite, 0) page, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from chunks where text is not null),
ln as (select *, case when n % 7 = 3 then 'table' when n % 5 = 4 then 'section_header' else 'text' end cls, case when n % 11 < 10 then cast(n * 20 % 790 as double) end t from ls)
"""
LAYOUT = {"stufen": [{"groesse": [13, 15], "fett": True}, {"groesse": [9, 11], "fett": True}], "klasse": "section_header", "hoechstlaenge": 60}


def margin_lines(spark, d: str) -> DataFrame:
    m = L.in_margin(F.col("top"), F.col("bottom"), F.col("page_h"), 30.0, 60.0)
    return _lines(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("zeilen"), F.count_if(m).alias("rand"), F.count_if(m.isNull()).alias("ohne_lage"))


MARGIN_SQL = f"with {_LINES} select page, count(*) zeilen, count(*) filter (t + 6 <= 30 or t + 6 >= 740) rand, count(*) filter (t is null) ohne_lage from ln group by 1"


def heading_levels(spark, d: str) -> DataFrame:
    level = L.layout_decision(F.col("cls"), F.col("text"), F.col("font"), LAYOUT)
    return _lines(spark, d).select("page", F.coalesce(level, F.lit(0)).alias("ebene")).groupBy("page", "ebene").agg(F.count(F.lit(1)).alias("n"))


LEVELS_SQL = f"""
with {_LINES}, e as (select page, case when cls = 'table' or length(trim(text)) > 60 then null when n % 3 > 0 then case when n % 4 = 0 then 1 when n % 2 = 0 then 2 end when cls = 'section_header' then 1 end e from ln)
select page, coalesce(e, 0) ebene, count(*) n from e group by 1, 2
"""


def heading_paths(spark, d: str) -> DataFrame:
    """Paths of a list of headings whose levels go 1, 2, 3, 2 in turn, one list a game."""
    c = table(spark, d, "chunks").where("spiel_id is not null")
    level = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(2)), (F.col("id") % 4 + 1).cast("int"))
    p = L.heading_paths(c.select("spiel_id", "id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("titel"), level.alias("ebene")), ["spiel_id"], "id", "titel", "ebene")
    return p.select("id", F.array_join("pfad", "/").alias("pfad"))


def section_texts(spark, d: str) -> DataFrame:
    """Lines of the chunks cut into sections at the headings their layout shows, joined to running text."""
    lines = _lines(spark, d)
    none = lines.limit(0).select("doc_id", "page", "line_no", F.lit(None).cast("array<string>").alias("pfad"), F.lit(0).alias("entry_no"), F.lit(True).alias("gefunden"))
    s = L.sections(lines, L.layout_headings(lines, none, LAYOUT))
    return s.select("doc_id", "abschnitt_nr", F.array_join("pfad", " › ").alias("pfad"), F.length("text").alias("zeichen"))


def listed_sections(spark, d: str) -> DataFrame:
    """Headings of a list found in the lines of the chunks: every chunk's third line is an entry, and one entry is nowhere."""
    lines = _lines(spark, d).where("trim(text) <> ''")
    e = lines.where("line_no = 2").select("doc_id", F.lit(1).alias("entry_no"), F.col("text").alias("titel"), F.lit(1).alias("ebene"), "page")
    gone = e.select("doc_id", F.lit(2).alias("entry_no"), F.lit("Gibt es nicht").alias("titel"), F.lit(2).alias("ebene"), "page")
    f = L.found_headings(lines, e.unionByName(gone))
    return f.groupBy("entry_no", "line_no", "gefunden").agg(F.count(F.lit(1)).alias("n"))


def majority_font(spark, d: str) -> DataFrame:
    """The font of each chunk out of nine glyphs whose fonts follow from its id."""
    c = table(spark, d, "chunks").select("id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("g"))
    i, g = F.col("id"), F.col("g")
    name = F.when((g + i) % 3 == 0, "ABC+Times-Bold").when((g * i) % 4 == 1, "Times-Italic").otherwise("ABC+Times")
    x = c.select("id", (g * 7.5).alias("x0"), (g * 7.5 + 5).alias("x1"), F.lit(100.04).alias("bottom"), F.when(i % 2 == 0, 10.02).otherwise(9.98 + (g % 2) * 0.5).alias("size"), name.alias("fontname"))
    m = L.majority_font(x, ["id"]).where("font is not null")
    return m.select("id", F.round("font.groesse", 1).alias("groesse"), F.col("font.fett").alias("fett"), F.col("font.kursiv").alias("kursiv"), F.round("font.laufweite", 6).alias("laufweite"))


FONT_SQL = """
with c as (select id, unnest(range(0, 9)) g from chunks), x as (select id, g * 7.5::double x0, g * 7.5::double + 5 x1, round(case when id % 2 = 0 then 10.02::double else 9.98::double + (g % 2) * 0.5::double end, 1) s,
  case when (g + id) % 3 = 0 then 1 when (g * id) % 4 = 1 then 2 else 0 end f from c),
l as (select *, lead(x0) over (partition by id, s, f order by x0) - x1 gap from x), q as (select id, s, f, count(*) n, coalesce(avg(gap), 0) w from l group by 1, 2, 3),
b as (select id, max(n) m, arg_max({'s': s, 'f': f, 'w': w}, n) z from q group by 1)
select id, z.s groesse, z.f = 1 fett, z.f = 2 kursiv, round(z.w, 6) laufweite from b where m * 2 > 9
"""


def glyph_lines(spark, d: str) -> DataFrame:
    """Glyphs on a grid assigned to the smallest of overlapping boxes."""
    c = table(spark, d, "chunks").select(F.col("id").alias("doc_id"), F.lit(1).alias("page"))
    lines = c.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("line_no"))
    n = F.col("line_no").cast("double")
    lines = lines.withColumn("x0", n * 30).withColumn("x1", n * 30 + 80).withColumn("top", n * 10).withColumn("bottom", n * 10 + 25 - (F.col("doc_id") % 3) * 5.0)
    glyphs = c.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("glyph_no"))
    g = F.col("glyph_no").cast("double")
    glyphs = glyphs.withColumn("x0", g * 17 + F.col("doc_id") % 5).withColumn("x1", F.col("x0") + 6).withColumn("top", g * 5).withColumn("bottom", F.col("top") + 8)
    return L.glyphs_to_lines(glyphs, lines).select("doc_id", "glyph_no", F.coalesce("line_no", F.lit(-1)).alias("line_no"))


GLYPH_SQL = """
with c as (select id from chunks), l as (select id, n, n * 30.0::double x0, n * 30.0::double + 80 x1, n * 10.0::double t, n * 10.0::double + 25 - (id % 3) * 5.0::double b from c, (select unnest(range(0, 4)) n)),
g as (select id, k, k * 17.0::double + id % 5 + 3 x, k * 5.0::double + 4 y from c, (select unnest(range(0, 10)) k)),
m as (select g.id, k, arg_min(n, ((x1 - x0) * (b - t), n)) line from g join l on l.id = g.id and x between x0 - 1 and x1 + 1 and y between t - 1 and b + 1 group by 1, 2)
select g.id doc_id, cast(g.k as int) glyph_no, coalesce(cast(m.line as int), -1) line_no from g left join m on m.id = g.id and m.k = g.k
"""


def printed_pages(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("seite_pdf is not null")
    p = L.printed_page(F.col("seite_pdf"), 4)
    none = F.lit(-1)
    return c.select("id", F.coalesce(p, none).alias("gedruckt"), F.coalesce(L.physical_page(p, 4), none).alias("physisch"), F.coalesce(L.labelled_page(F.array(F.lit("i"), F.lit("ii"), F.lit("iii"), F.lit("iv"), F.lit("1"), F.lit("2")), F.least("seite_pdf", F.lit(6))), none).alias("label"))


PRINTED_SQL = """
select id, case when seite_pdf - 4 >= 1 then seite_pdf - 4 else -1 end gedruckt, case when seite_pdf - 4 >= 1 then seite_pdf else -1 end physisch, case when seite_pdf = 5 then 1 when seite_pdf >= 6 then 2 else -1 end label from chunks where seite_pdf is not null
"""


def suspicion_counts(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null and spiel_id is not null")
    return L.suspicions(c, ["spiel_id"], "text", "seite_pdf", T.CONJUNCTIONS["de"]).select("spiel_id", "art", "anzahl", F.array_join("seiten", ",").alias("seiten"))


SUSPICION_SQL = r"""
with c as (select spiel_id, seite_pdf p, text t from chunks where text is not null and spiel_id is not null),
u as (select spiel_id, p, 'binnen_grossbuchstabe' art, len(regexp_extract_all(t, '\p{Ll}\p{Lu}')) n from c
  union all select spiel_id, p, 'strichrest', len(list_filter(regexp_extract_all(t, '\p{L}- +([\p{L}\p{N}\p{M}_]+)', 1), lambda w: regexp_matches(w, '^\p{Ll}') and lower(w) not in ('und', 'oder', 'bis', 'sowie', 'bzw'))) from c)
select spiel_id, art, cast(sum(n) as bigint) anzahl, string_agg(distinct p, ',' order by p) seiten from u where n > 0 group by 1, 2
"""


def dehyphenated_lines(spark, d: str) -> DataFrame:
    """Lines of chunks joined to running text, with the numbers of joined and kept dashes."""
    r = T.dehyphenated(F.split("text", "\n"))
    return table(spark, d, "chunks").where("text is not null").select("id", r.alias("r")).select("id", F.md5("r.text").alias("hash"), "r.verbunden", "r.behalten")


def key_forms(spark, d: str) -> DataFrame:
    """Names of games in the forms that names, titles, lines and verdicts are compared in."""
    s, n = table(spark, d, "spiele").where("spiel_name is not null"), F.col("spiel_name")
    return s.select("spiel_id", T.chat_key(n).alias("chat"), T.title_norm(n).alias("titel"), T.line_key(n).alias("zeile"), T.judge_norm(n).alias("urteil"), T.without_politeness(F.concat(n, F.lit(" bitte Danke"))).alias("ohne"))


KEYS_SQL = r"""
with s as (select spiel_id, spiel_name n, regexp_replace(replace(lower(spiel_name), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') k from spiele where spiel_name is not null)
select spiel_id, strip_accents(replace(replace(replace(k, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')) chat, trim(regexp_replace(n, '\s+', ' ', 'g')) titel, replace(lower(regexp_replace(n, '[\s\p{Cf}]+', '', 'g')), 'ß', 'ss') zeile,
 replace(replace(replace(replace(lower(trim(regexp_replace(n, '\s+', ' ', 'g'))), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') urteil, trim(regexp_replace(n, '\s+', ' ', 'g')) ohne from s
"""

QUERIES = {
    "fingerprints": fingerprints, "index_status": index_status, "stale_collections": stale_collections, "index_removed": index_removed, "dropped_collections": dropped_collections, "book_steps": book_steps,
    "index_refresh": index_refresh, "pos_renumber": pos_renumber, "replaced_rows": replaced_rows, "collection_hashes": collection_hashes, "snapshot_tags": snapshot_tags, "config_fields": config_fields,
    "collections_without_golden": collections_without_golden, "chain_questions": chain_questions, "history_split": history_split, "chat_choice": chat_choice, "margin_lines": margin_lines,
    "heading_levels": heading_levels, "heading_paths": heading_paths, "section_texts": section_texts, "listed_sections": listed_sections, "majority_font": majority_font, "glyph_lines": glyph_lines,
    "printed_pages": printed_pages, "suspicion_counts": suspicion_counts, "dehyphenated_lines": dehyphenated_lines, "key_forms": key_forms,
}
SQL = {
    "fingerprints": FINGER_SQL, "index_status": STATUS_SQL, "stale_collections": STALE_SQL, "index_removed": REMOVED_SQL, "dropped_collections": DROPPED_SQL, "book_steps": STEPS_SQL, "index_refresh": REFRESH_SQL,
    "pos_renumber": RENUMBER_SQL, "replaced_rows": REPLACED_SQL, "collection_hashes": COLLECTION_SQL, "snapshot_tags": TAGS_SQL, "config_fields": CONFIG_SQL, "collections_without_golden": NO_GOLDEN_SQL,
    "chain_questions": CHAIN_SQL, "history_split": SPLIT_SQL, "margin_lines": MARGIN_SQL, "heading_levels": LEVELS_SQL, "majority_font": FONT_SQL, "glyph_lines": GLYPH_SQL, "printed_pages": PRINTED_SQL,
    "suspicion_counts": SUSPICION_SQL, "key_forms": KEYS_SQL,
}
