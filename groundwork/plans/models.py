"""Named queries around plugged-in models and readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import seams as S
from groundwork.functions import text as T
from groundwork.operators import chunking as C
from groundwork.operators import measuring as M
from groundwork.plans.books import WS
from groundwork.plans.judging import _RUNS, _runs
from groundwork.session import table


def hash_embeddings(spark, d: str) -> DataFrame:
    v = S.hash_embedding(F.col("frage"))
    return table(spark, d, "golden_set").where("frage is not null").select("spiel_id", "frage_id", F.round(v[0], 6).alias("erste"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("summe"))


HASH_SQL = """
with h as (select spiel_id, frage_id, sha256(frage) h from golden_set where frage is not null),
v as (select spiel_id, frage_id, list_transform(range(0, 8), lambda i: cast('0x' || substring(h, cast(2 * i + 1 as int), 2) as int) / 255.0::double - 0.5) v from h)
select spiel_id, frage_id, round(v[1], 6) erste, round(list_sum(v), 6) summe from v
"""


def axis_embeddings(spark, d: str) -> DataFrame:
    v = S.axis_embedding(F.col("text"), ["turm", "karte", "tor"])
    return table(spark, d, "chunks").where("text is not null").select("id", *[v[i].alias(n) for i, n in enumerate(("turm", "karte", "tor", "rest"))])


AXIS_SQL = """
with c as (select id, lower(text) t from chunks where text is not null),
n as (select id, cast((length(t) - length(replace(t, 'turm', ''))) / 4 as double) turm, cast((length(t) - length(replace(t, 'karte', ''))) / 5 as double) karte, cast((length(t) - length(replace(t, 'tor', ''))) / 3 as double) tor from c)
select *, cast(case when turm + karte + tor > 0 then 0.1 else 1.0 end as double) rest from n
"""


def page_text_chunks(spark, d: str) -> DataFrame:
    """Pages of documents, whitespace collapsed, in windows of 400 characters with 150 of overlap."""
    p = table(spark, d, "documents").where("seite is not null").select("doc_id", "seite", "text")
    return C.page_chunks(p, "seite", "text", 400, 150).select("doc_id", "seite", "piece_no", F.md5("piece").alias("hash"))


PAGE_SQL = f"""
with p as (select doc_id, seite, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') t from documents where seite is not null and text is not null),
w as (select doc_id, seite, t, unnest(range(0, length(t), 250)) s from p where t <> '')
select doc_id, seite, cast(s // 250 as int) piece_no, md5(substring(t, cast(s as int) + 1, 400)) hash from w
"""


def retrieved_pages(spark, d: str) -> DataFrame:
    """Pages with their books that each answer retrieved, each chunk taken to span its page and the next."""
    a = table(spark, d, "antworten").where("antwort_id is not null").dropDuplicates(["antwort_id"]).select("antwort_id", F.posexplode("abgerufen_id").alias("rang", "id"))
    c = table(spark, d, "chunks").where("seite is not null").select("id", "buch_id", F.array("seite", F.col("seite") + 1).alias("seiten"))
    r = M.retrieved_pages(a.join(c, "id"), ["antwort_id"], "rang", "buch_id", "seiten")
    return r.select("antwort_id", F.array_join(F.transform("abgerufen", lambda x: F.concat_ws(":", F.coalesce(x["buch_id"], F.lit("?")), x["seite"].cast("string"))), ",").alias("abgerufen"))


RETRIEVED_SQL = """
with a as (select antwort_id, any_value(abgerufen_id) i from antworten where antwort_id is not null group by 1), u as (select antwort_id, unnest(i) id, generate_subscripts(i, 1) r from a),
p as (select antwort_id, r, coalesce(buch_id, '?') || ':' || seite x, 0 o from u join chunks using (id) where seite is not null union all select antwort_id, r, coalesce(buch_id, '?') || ':' || (seite + 1), 1 from u join chunks using (id) where seite is not null),
f as (select antwort_id, x, min(r * 2 + o) k from p group by 1, 2)
select antwort_id, string_agg(x, ',' order by k) abgerufen from f group by 1
"""


def setting_comparison(spark, d: str) -> DataFrame:
    """Every setting against setting 0: questions that all runs judge better, or worse."""
    return M.comparison(_runs(spark, d), "setting", "0", ["spiel_id", "frage_id"])


COMPARISON_SQL = f"""
with {_RUNS}, r as (select setting, spiel_id, frage_id, case urteil when 'falsch' then 0 when 'unsicher' then 1 when 'teilweise' then 2 when 'richtig' then 3 end s from ru),
g as (select setting, spiel_id, frage_id, min(s) lo, max(s) hi from r group by 1, 2, 3 having count(s) = count(*) and count(*) >= 2),
j as (select g.setting, g.lo, g.hi, b.lo blo, b.hi bhi from g join g b on b.spiel_id = g.spiel_id and b.frage_id = g.frage_id and b.setting = '0' where g.setting <> '0')
select setting, count(*) filter (lo > bhi) verbessert, count(*) filter (hi < blo) verschlechtert from j group by 1
"""


def without_footers(spark, d: str) -> DataFrame:
    """Answers with the lines behind them that a chat adds, and without them again."""
    a = table(spark, d, "antworten").where("antwort_id is not null and antwort is not null").dropDuplicates(["antwort_id"])
    foot = F.element_at(F.array(F.lit(""), F.lit("\n\n---\n*Abgerufen: Seite 3*"), F.lit("\n\nHinweis: nur teilweise belegt -- pruef S. 3.\n\n---\n*Quelle: Azul, Seite 3*"), F.lit("\n\n**Fehler in der RAG-Pipe:** x\ny")), (F.col("antwort_id") % 4 + 1).cast("int"))
    return a.select("antwort_id", F.md5(T.without_footer(F.concat("antwort", foot))).alias("hash"))


FOOTER_SQL = "select antwort_id, md5(any_value(antwort)) hash from antworten where antwort_id is not null group by 1 having any_value(antwort) is not null"


def soft_hyphens(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("id", F.length(T.without_soft_hyphens(F.col("text"))).alias("zeichen"))


SOFT_SQL = "select id, cast(length(replace(text, chr(173), '')) as int) zeichen from chunks where text is not null"

QUERIES = {
    "hash_embeddings": hash_embeddings, "axis_embeddings": axis_embeddings, "page_text_chunks": page_text_chunks, "retrieved_pages": retrieved_pages, "setting_comparison": setting_comparison,
    "without_footers": without_footers, "soft_hyphens": soft_hyphens,
}
SQL = {
    "hash_embeddings": HASH_SQL, "axis_embeddings": AXIS_SQL, "page_text_chunks": PAGE_SQL, "retrieved_pages": RETRIEVED_SQL, "setting_comparison": COMPARISON_SQL, "without_footers": FOOTER_SQL,
    "soft_hyphens": SOFT_SQL,
}
