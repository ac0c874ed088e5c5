"""Named queries over collections of several books, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import books as B
from groundwork.operators import layout as L
from groundwork.operators import names as N
from groundwork.session import table
from groundwork.sources import files

#: Whitespace in the SQL's regular expressions, as Java's Unicode class has it.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _typed(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("spiel_id is not null").withColumn("art", F.trim("typ"))


def _rules(spark, d: str) -> DataFrame:
    """For rules, the latest edition of each game is authoritative, the oldest is annotated."""
    g = _typed(spark, d).groupBy("spiel_id").agg(F.max("fassung").alias("hi"), F.min("fassung").alias("lo")).where("hi is not null")
    return g.select("spiel_id", F.lit("regel").alias("art"), F.array("hi").alias("authoritative"), F.create_map("lo", F.lit("aeltere Fassung")).alias("annotated"))


def edition_rule(spark, d: str) -> DataFrame:
    c = B.with_edition_rule(_typed(spark, d), _rules(spark, d), "spiel_id", "art", "fassung")
    return c.groupBy("spiel_id", "art", "fassung").agg(F.count(F.lit(1)).alias("n"), F.count("hinweis").alias("hinweise"))


_RULED = """
r as (select spiel_id, max(fassung) hi, min(fassung) lo from chunks where spiel_id is not null group by 1),
k as (select c.*, trim(typ) art, hi, lo from chunks c join r using (spiel_id)),
e as (select *, case when art = 'regel' and fassung <> hi and fassung = lo then 'aeltere Fassung' end hinweis from k
  where art is null or art <> 'regel' or hi is null or coalesce(fassung = hi or fassung = lo, false))
"""
EDITION_SQL = f"with {_RULED} select spiel_id, art, fassung, count(*) n, count(hinweis) hinweise from e group by 1, 2, 3"


def kind_by_prefix(spark, d: str) -> DataFrame:
    """Kinds by rules for first headings up to R and for pairs of headings of which the second is from N on."""
    c = table(spark, d, "chunks").where("spiel_id is not null")
    p = F.col("abschnittspfad")
    one = c.where((F.size(p) >= 1) & (p[0] < "S")).select("spiel_id", F.lit(0).alias("rule_no"), F.slice(p, 1, 1).alias("prefix")).distinct()
    two = c.where((F.size(p) >= 2) & (F.get(p, F.lit(1)) > "M")).select("spiel_id", F.lit(1).alias("rule_no"), F.slice(p, 1, 2).alias("prefix")).distinct()
    rules = one.unionByName(two).withColumn("kind", F.array_join("prefix", "/"))
    return B.kind_by_prefix(c, rules, "id", ["spiel_id"], "abschnittspfad", F.lit("grund")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


KIND_SQL = """
with k as (select case when len(abschnittspfad) >= 2 and abschnittspfad[2] > 'M' then abschnittspfad[1] || '/' || abschnittspfad[2]
  when len(abschnittspfad) >= 1 and abschnittspfad[1] < 'S' then abschnittspfad[1] else 'grund' end kind from chunks where spiel_id is not null)
select kind, count(*) n from k group by 1
"""


def _books(spark, d: str) -> DataFrame:
    s = table(spark, d, "spiele").dropDuplicates(["spiel_id"])
    return B.books_of(s, "spiel_id", "buecher").join(s.select("spiel_id", "spiel_name"), "spiel_id").withColumn("titel", F.concat_ws(" – ", "spiel_name", "buch_id"))


def book_list(spark, d: str) -> DataFrame:
    return _books(spark, d).select("spiel_id", "buch_nr", "buch_id", "fassung", "titel")


_BOOKS = """
s as (select spiel_id, any_value(spiel_name) n, any_value(buecher) b from spiele group by 1),
x as (select spiel_id, n, unnest(case when coalesce(len(b), 0) = 0 then [null] else b end) u, generate_subscripts(case when coalesce(len(b), 0) = 0 then [null] else b end, 1) i from s),
bk as (select spiel_id, cast(i - 1 as int) buch_nr, coalesce(u.buch_id, 'regelwerk') buch_id, u.fassung fassung, n || ' – ' || coalesce(u.buch_id, 'regelwerk') titel from x)
"""
BOOKS_SQL = f"with {_BOOKS} select * from bk"


def multi_book_scan(spark, d: str) -> DataFrame:
    """Chunks under the edition rule with title and citation."""
    c = B.with_edition_rule(_typed(spark, d).where("buch_id is not null"), _rules(spark, d), "spiel_id", "art", "fassung")
    c = B.with_titles(c, _books(spark, d).dropDuplicates(["spiel_id", "buch_id"]), ["spiel_id"], "buch_id")
    return c.select("id", B.citation(F.col("titel"), F.col("fassung"), F.col("seite"), F.col("seite_pdf"), F.col("hinweis")).alias("fundstelle"))


SCAN_SQL = f"""
with {_RULED}, {_BOOKS}, t as (select spiel_id, buch_id, any_value(titel) titel from bk group by 1, 2)
select id, coalesce(titel, e.buch_id) || ' (' || coalesce(fassung, '?') || '), ' || case when seite is not null then 'S. ' || seite else 'PDF-S. ' || coalesce(cast(seite_pdf as varchar), '?') end
  || case when hinweis is not null then ' (' || hinweis || ')' else '' end fundstelle
from e left join t on t.spiel_id = e.spiel_id and t.buch_id = e.buch_id where e.buch_id is not null
"""


def declaration_errors(spark, d: str) -> DataFrame:
    """Faults of books as chunks name them: every (game, book, edition) counts as declared once."""
    b = table(spark, d, "chunks").where("spiel_id is not null").select("spiel_id", "buch_id", "fassung").distinct()
    return B.declaration_errors(b, "spiel_id")


DECLARATION_SQL = """
with b as (select distinct spiel_id, buch_id, fassung from chunks where spiel_id is not null), c as (select *, count(*) over (partition by spiel_id, buch_id) n from b),
f as (select spiel_id, buch_id, case when buch_id is null or not regexp_matches(buch_id, '^[a-z0-9]+(-[a-z0-9]+)*$') then 'schluessel' end fehler from c
  union all select spiel_id, buch_id, case when n > 1 then 'doppelt' end from c union all select spiel_id, buch_id, case when coalesce(trim(fassung), '') = '' then 'fassung' end from c)
select distinct * from f where fehler is not null
"""


def shared_names(spark, d: str) -> DataFrame:
    """Keys that the aliases of several games share."""
    s = table(spark, d, "spiele").select("spiel_id", F.explode(F.array_append(F.coalesce("aliase", F.array().cast("array<string>")), F.col("spiel_name"))).alias("name"))
    return N.shared_names(s, "spiel_id", "name").select("schluessel", F.array_join("spiele", ",").alias("spiele"))


SHARED_SQL = r"""
with a as (select spiel_id, unnest(list_append(coalesce(aliase, []), spiel_name)) n from spiele),
k as (select distinct spiel_id, regexp_replace(replace(lower(n), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') schluessel from a where n is not null)
select schluessel, string_agg(spiel_id, ',' order by spiel_id) spiele from k where schluessel <> '' group by 1 having count(*) > 1
"""


def resolve_fuzzy(spark, d: str) -> DataFrame:
    """Names of games with a letter left out, and their first words, resolved against the whole catalogue."""
    s = table(spark, d, "spiele").where("spiel_name is not null")
    asked = s.select(F.concat(F.substring("spiel_name", 1, 3), F.expr("substring(spiel_name, 5)")).alias("anfrage")).unionByName(s.select(F.substring_index("spiel_name", " ", 1).alias("anfrage")))
    return N.resolved(asked, N.catalogue(s, "spiel_name", "aliase")).select("anfrage", "art", F.array_join("namen", "; ").alias("namen"))


def chunk_page_spans(spark, d: str) -> DataFrame:
    """Chunks as sections over two pages, cut to 400 characters with 150 of overlap, behind their headings."""
    c = table(spark, d, "chunks").where("spiel_id is not null and buch_id is not null and seite is not null")
    breaks = F.array(F.struct(F.lit(0).alias("offset"), F.col("seite").alias("page")), F.struct(F.lit(300).alias("offset"), (F.col("seite") + 1).alias("page")))
    s = c.select("spiel_id", "buch_id", "id", F.coalesce("abschnittspfad", F.array().cast("array<string>")).alias("pfad"), "text", breaks.alias("umbrueche"))
    p = B.section_chunks(s, ["spiel_id", "buch_id"], "id", 400, 150)
    return p.select("spiel_id", "buch_id", "pos", "start", F.md5("text").alias("hash"), "seite", F.array_join("seiten", ",").alias("seiten"))


SPANS_SQL = """
with c as (select spiel_id, buch_id, id, coalesce(abschnittspfad, []) p, text, seite, unnest(range(0, length(text), 250)) s from chunks where spiel_id is not null and buch_id is not null and seite is not null and text is not null),
q as (select *, substring(text, cast(s as int) + 1, 400) t from c)
select spiel_id, buch_id, cast(row_number() over (partition by spiel_id, buch_id order by id, s) - 1 as int) pos, cast(s as int) "start",
 md5(case when len(p) > 0 then array_to_string(p, ' › ') || chr(10) || t else t end) hash,
 case when s < 300 then seite else seite + 1 end seite, case when s >= 300 then cast(seite + 1 as varchar) when s + length(t) > 300 then seite || ',' || (seite + 1) else cast(seite as varchar) end seiten from q
"""


def page_blocks(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("spiel_id is not null and seite is not null")
    b = L.page_blocks(c, ["spiel_id", "seite"], "id", "text", 1200)
    return b.select("spiel_id", "seite", "block_nr", F.md5("block").alias("hash"))


PAGE_BLOCKS_SQL = rf"""
with p as (select spiel_id, seite, string_agg(text, chr(10) || chr(10) order by id) t from chunks where spiel_id is not null and seite is not null and text is not null group by 1, 2),
w as (select spiel_id, seite, list_filter(list_transform(string_split_regex(t, '\n[\s\x{{0b}}]*\n'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') l from p),
f as (select spiel_id, seite, list_reduce(l, lambda a, x: case when length(string_split(a, chr(1))[-1]) + length(x) > 1200 then a || chr(1) || x else a || chr(10) || chr(10) || x end) r from w where len(l) > 0),
b as (select spiel_id, seite, string_split(r, chr(1)) l from f),
u as (select spiel_id, seite, unnest(l) t, generate_subscripts(l, 1) - 1 i from b)
select spiel_id, seite, cast(i as int) block_nr, md5(t) hash from u
"""


def page_routes(spark, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("spiel_id is not null and seite is not null").withColumn("cls", F.coalesce("route", F.lit("text")))
    return L.page_routes(c, ["spiel_id", "seite"], 5)


ROUTES_SQL = """
with g as (select spiel_id, seite, count(*) filter (coalesce(route, 'text') <> 'table') texte, count(*) filter (coalesce(route, 'text') = 'table') tabellen from chunks where spiel_id is not null and seite is not null group by 1, 2)
select *, case when texte > 5 then 'vision' else 'text/table' end route from g
"""


def route_counts(spark, d: str) -> DataFrame:
    return L.layout_histogram(table(spark, d, "chunks").where("spiel_id is not null"), ["spiel_id", "buch_id"], "route")


ROUTE_SQL = "select spiel_id, buch_id, route, count(*) n from chunks where spiel_id is not null group by 1, 2, 3"


def named_values(spark, d: str) -> DataFrame:
    """Lines of the form ``name: value`` in documents."""
    v = T.named_values(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(v).alias("n"), F.md5(F.array_join(v, "\n")).alias("hash")).where("n > 0")


NAMED_SQL = rf"""
with l as (select doc_id, list_transform(string_split_regex(text, '\r\n|[\n\x{{0b}}\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '^({WS}|[-*0-9.])+', ''), '{WS}+$', '')) l from documents where text is not null),
v as (select doc_id, list_filter(l, lambda x: contains(x, ':') and length(x) > 5) v from l)
select doc_id, cast(len(v) as int) n, md5(array_to_string(v, chr(10))) hash from v where len(v) > 0
"""


def image_pages(spark, d: str) -> DataFrame:
    """Pages of images by their names; every fifth is given."""
    c = table(spark, d, "chunks")
    name = F.concat(F.lit("scan_seite_"), F.coalesce(F.col("seite_pdf").cast("string"), F.lit("x")), F.lit(".png"))
    return c.select("id", T.page_of_name(name, F.when(F.col("id") % 5 == 0, F.col("seite"))).alias("seite")).where("seite is not null")


IMAGE_SQL = "select id, coalesce(case when id % 5 = 0 then seite end, seite_pdf) seite from chunks where coalesce(case when id % 5 = 0 then seite end, seite_pdf) >= 1"


def pageless_questions(spark, d: str) -> DataFrame:
    """What would be pageless if no refusal were expected anywhere."""
    return files.pageless(table(spark, d, "golden_set").withColumn("erwartet_verweigerung", F.lit(None).cast("boolean")))


PAGELESS_SQL = "select spiel_id, frage_id from golden_set where coalesce(len(seiten), 0) = 0"


def page_texts(spark, d: str) -> DataFrame:
    """Expected pages of questions as text, to read and to be read out."""
    g = table(spark, d, "golden_set").where("size(seiten) > 0")
    return g.select("spiel_id", "frage_id", B.page_list(F.col("seiten")).alias("kurz"), B.page_list(F.col("seiten"), True).alias("gesprochen"))


PAGE_TEXTS_SQL = """
with l as (select spiel_id, frage_id, list_transform(seiten, lambda x: 'S. ' || x) k, list_transform(seiten, lambda x: 'Seite ' || x) g from golden_set where len(seiten) > 0)
select spiel_id, frage_id, array_to_string(k, ', ') kurz, case when len(g) = 1 then g[1] else array_to_string(g[1:len(g) - 1], ', ') || ' und ' || g[len(g)] end gesprochen from l
"""

QUERIES = {
    "edition_rule": edition_rule, "kind_by_prefix": kind_by_prefix, "book_list": book_list, "multi_book_scan": multi_book_scan, "declaration_errors": declaration_errors,
    "shared_names": shared_names, "resolve_fuzzy": resolve_fuzzy, "chunk_page_spans": chunk_page_spans, "page_blocks": page_blocks, "page_routes": page_routes, "route_counts": route_counts,
    "named_values": named_values, "image_pages": image_pages, "pageless_questions": pageless_questions, "page_texts": page_texts,
}
SQL = {
    "edition_rule": EDITION_SQL, "kind_by_prefix": KIND_SQL, "book_list": BOOKS_SQL, "multi_book_scan": SCAN_SQL, "declaration_errors": DECLARATION_SQL, "shared_names": SHARED_SQL,
    "chunk_page_spans": SPANS_SQL, "page_blocks": PAGE_BLOCKS_SQL, "page_routes": ROUTES_SQL, "route_counts": ROUTE_SQL, "named_values": NAMED_SQL, "image_pages": IMAGE_SQL,
    "pageless_questions": PAGELESS_SQL, "page_texts": PAGE_TEXTS_SQL,
}
