"""Named queries: chunking, filters, vector and word ranking, fusion; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import chunking as C
from groundwork.operators import ranking as R
from groundwork.session import table

K = 10


def _vectors(spark, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("v"))
    # a question set of its own: every row whose id is divisible by 20
    q = e.where("id % 20 = 0").select(F.col("id").alias("question"), "collection", F.col("v").alias("q"))
    return q, e.withColumn("pos", F.col("id"))


def vector_topk(spark, d: str) -> DataFrame:
    q, e = _vectors(spark, d)
    return R.vector_topk(q, e, "collection", 4).select(F.col("question").cast("bigint").alias("question"), "id", "rank", F.round("score", 6).alias("score"))


VECTOR_SQL = """
with p as (select a.vec_id question, b.vec_id id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) s
  from embeddings a join embeddings b on a.label = b.label where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by question order by s desc, id) k from p)
select question, id, cast(k as int) rank, round(s, 6) score from r where k <= 4
"""


def l2_normalize(spark, d: str) -> DataFrame:
    v = R.l2_normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("summe"), F.round(F.get(v, F.lit(0)), 6).alias("erste"))


L2_SQL = """
with n as (select vec_id, embedding::double[] e, sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9 n from embeddings)
select vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) summe, round(e[1] / n, 6) erste from n
"""


def chunk_windows(spark, d: str) -> DataFrame:
    w = C.chunk_windows(table(spark, d, "documents").select("doc_id", "text"), size=800, overlap=150)
    return w.select("doc_id", "piece_no", "start", F.md5("piece").alias("md5"))


WINDOWS_SQL = """
with s as (select doc_id, text, unnest(range(0, length(text), 650)) st from documents where text is not null and length(text) > 0)
select doc_id, cast(st // 650 as int) piece_no, cast(st as int) start, md5(array_to_string(list_slice(string_split(text, ''), st + 1, st + 800), '')) md5 from s
"""


def drop_types_null_kept(spark, d: str) -> DataFrame:
    c = R.drop_types(table(spark, d, "chunks"), ["flavor", "meta"])
    return c.groupBy("spiel_id").agg(F.count(F.lit(1)).alias("n"))


DROP_SQL = "select spiel_id, count(*) n from chunks where typ is null or trim(typ) not in ('flavor', 'meta') group by 1"


def filtered_books(spark, d: str) -> DataFrame:
    c = R.equal_to(table(spark, d, "chunks"), buch_id="grundregel", sprache="de")
    return c.groupBy("spiel_id", "fassung").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("erste"))


BOOKS_SQL = "select spiel_id, fassung, count(*) n, min(pos) erste from chunks where buch_id = 'grundregel' and sprache = 'de' group by 1, 2"


def query_terms(spark, d: str) -> DataFrame:
    g = table(spark, d, "golden_set")
    return g.select("spiel_id", "frage_id", F.array_join(T.query_terms(F.col("frage")), " ").alias("terme"))


TERMS_SQL = r"""
with t as (select spiel_id, frage_id, regexp_extract_all(lower(frage), '[\p{L}\p{M}\p{N}_]+') w from golden_set)
select spiel_id, frage_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') terme from t
"""


def _corpus(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("spiel_id is not null").select("id", F.col("spiel_id").alias("collection"), "pos", "text", "emb")


def _questions(spark, d: str) -> DataFrame:
    g = table(spark, d, "golden_set").where("frage is not null")
    return g.select(F.concat_ws("#", "spiel_id", "frage_id").alias("question"), F.col("spiel_id").alias("collection"), "frage")


def term_postings(spark, d: str) -> DataFrame:
    p = R.postings(_corpus(spark, d))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_TOK = r"regexp_extract_all(translate(lower({0}), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{{L}}\p{{N}}]+')"
POSTINGS_SQL = f"""
with t as (select id, unnest({_TOK.format('text')}) term from chunks where text is not null and spiel_id is not null),
p as (select id, term, count(*) tf from t group by 1, 2)
select term, count(*) df, cast(sum(tf) as bigint) cf from p group by 1
"""


def bm25_topk(spark, d: str) -> DataFrame:
    return R.bm25(_questions(spark, d), _corpus(spark, d), K).select("question", "id", "rank", F.round("score", 5).alias("score"))


_BM25 = f"""
w as (select id, spiel_id, pos, {_TOK.format('text')} t from chunks where text is not null and spiel_id is not null),
st as (select count(*) n, avg(len(t) + 1) m from w),
x as (select id, spiel_id, pos, len(t) + 1 l, unnest(t) term from w),
tf as (select id, spiel_id, pos, l, term, count(*) tf from x group by all),
df as (select term, count(*) df from tf group by 1),
q as (select distinct spiel_id || '#' || frage_id question, spiel_id, unnest({_TOK.format('frage')}) term from golden_set where frage is not null),
sc as (select question, id, pos, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 9) s
  from q join tf using (spiel_id, term) join df using (term), st group by 1, 2, 3),
b as (select *, row_number() over (partition by question order by s desc, pos, id) r from sc)
"""
BM25_SQL = f"with {_BM25} select question, id, cast(r as int) rank, round(s, 5) score from b where r <= {K}"


def _asked(spark, d: str) -> DataFrame:
    """Chunks whose id is divisible by 20, as questions with a text and a vector, against all chunks."""
    c = _usable(spark, d).where("id % 20 = 0 and text is not null")
    return c.select(F.col("id").cast("string").alias("question"), "collection", F.col("text").alias("frage"), F.col("v").alias("q"))


def _usable(spark, d: str) -> DataFrame:
    """Chunks with a vector of 32 numbers, not all zero."""
    v = F.col("emb")
    c = _corpus(spark, d).where((F.size(v) == 32) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))
    return c.select("id", "collection", "pos", "text", R.l2_normalized(v).alias("v"))


def hybrid_topk(spark, d: str) -> DataFrame:
    """Flagship: the vector list and the BM25 list, both cut to 20 candidates, fused by reciprocal ranks."""
    return R.hybrid(_asked(spark, d), _usable(spark, d), 4).select("question", "id", "rank", F.round("score", 9).alias("score"))


_USABLE = """
e as (select id, spiel_id, pos, text, list_transform(emb, lambda x: x::double) v from chunks where spiel_id is not null and len(emb) = 32
  and len(list_filter(emb, lambda x: x is null or isnan(x))) = 0 and len(list_filter(emb, lambda x: x <> 0)) > 0),
u as (select id, spiel_id, pos, text, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) v from e),
vp as (select cast(a.id as varchar) question, b.id, b.pos, round(list_dot_product(a.v, b.v), 9) s from u a join u b on a.spiel_id = b.spiel_id where a.id % 20 = 0 and a.text is not null),
vr as (select *, row_number() over (partition by question order by s desc, pos, id) r from vp)
"""
HYBRID_SQL = f"""
with {_USABLE},
w as (select id, spiel_id, pos, {_TOK.format('text')} t from u where text is not null),
st as (select count(*) n, avg(len(t) + 1) m from w),
x as (select id, spiel_id, pos, len(t) + 1 l, unnest(t) term from w),
tf as (select id, spiel_id, pos, l, term, count(*) tf from x group by all),
df as (select term, count(*) df from tf group by 1),
q as (select distinct cast(id as varchar) question, spiel_id, unnest({_TOK.format('text')}) term from u where text is not null and id % 20 = 0),
sc as (select question, id, pos, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 9) s
  from q join tf using (spiel_id, term) join df using (term), st group by 1, 2, 3),
b as (select *, row_number() over (partition by question order by s desc, pos, id) r from sc),
al as (select question, id, 0 l, r from vr where r <= 20 union all select question, id, 1, r from b where r <= 20),
g as (select question, id, round(sum(1.0::double / (60 + r)), 12) s, min(l * 1000 + r) f from al group by 1, 2),
z as (select *, row_number() over (partition by question order by s desc, f) n from g)
select question, id, cast(n as int) rank, round(s, 9) score from z where n <= 4
"""


def topk_path_compare(spark, d: str) -> DataFrame:
    """The matrix way of ranking against the plain join, question by question."""
    q, e = _vectors(spark, d)
    return R.topk_difference(R.pairwise_topk(q, e, "collection", 8), R.vector_topk(q, e, "collection", 8))


PATH_SQL = "select cast(vec_id as varchar) question, true gleich, 0.0::double abweichung from embeddings where vec_id % 20 = 0"


def tie_group_compare(spark, d: str) -> DataFrame:
    """Top lists of coarsely rounded scores, ties by position against ties by the other end: the same but for ties."""
    q, e = _vectors(spark, d)
    every = q.join(e, "collection").select("question", "id", "pos", F.round(R.dot(F.col("q"), F.col("v")), 1).alias("score"))
    up = R.ranked(every, ["question"], "score", ["pos"], 8)
    down = R.ranked(every.withColumn("gegen", -F.col("pos")), ["question"], "score", ["gegen"], 8)
    same = R.same_but_ties(down, up, every)
    moved = up.groupBy("question").agg(F.sort_array(F.collect_list("id")).alias("a")).join(down.groupBy("question").agg(F.sort_array(F.collect_list("id")).alias("b")), "question")
    return same.join(moved.select("question", (F.col("a") == F.col("b")).alias("auch_gleiche_treffer")), "question")


TIE_SQL = """
with p as (select a.vec_id question, b.vec_id id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 1) s
  from embeddings a join embeddings b on a.label = b.label where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by question order by s desc, id) x, row_number() over (partition by question order by s desc, id desc) y from p)
select question, true gleich, list_sort(list(id) filter (x <= 8)) = list_sort(list(id) filter (y <= 8)) auch_gleiche_treffer from r group by 1
"""


def rerank_overlap(spark, d: str) -> DataFrame:
    """The ten best by BM25 in the order of a pair score: shared words and a little for short texts."""
    c = R.bm25(_questions(spark, d), _corpus(spark, d), K)
    c = c.join(_questions(spark, d).dropDuplicates(["question"]), "question").join(_corpus(spark, d).select("id", "text"), "id")
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    score = F.size(F.array_intersect(words(F.col("frage")), words(F.col("text")))) + F.lit(1.0) / (1 + F.length("text"))
    return R.reranked(c, score, 4).select("question", "id", "rank", F.round("pair_score", 6).alias("score"))


_RERANK_WORDS = r"list_filter(list_distinct(regexp_split_to_array(lower({0}), '\s+')), lambda w: w <> '')"
RERANK_SQL = f"""
with {_BM25}, c as (select question, id, r from b where r <= {K}),
f as (select spiel_id || '#' || frage_id question, any_value(frage) frage from golden_set where frage is not null group by 1),
p as (select c.question, c.id, c.r, len(list_intersect({_RERANK_WORDS.format('f.frage')}, {_RERANK_WORDS.format('t.text')})) + 1.0::double / (1 + length(t.text)) s
  from c join f using (question) join chunks t on t.id = c.id),
z as (select *, row_number() over (partition by question order by s desc, r) n from p)
select question, id, cast(n as int) rank, round(s, 6) score from z where n <= 4
"""


def hit_pages(spark, d: str) -> DataFrame:
    """Pages of the BM25 hits of every golden question, in rank order."""
    h = R.bm25(_questions(spark, d), _corpus(spark, d), K).join(table(spark, d, "chunks").select("id", F.coalesce("seite", "seite_pdf").alias("seite")), "id")
    return R.pages_of(h, ["question"], "rank", "seite").select("question", F.array_join("seiten", ",").alias("seiten"))


PAGES_SQL = f"""
with {_BM25}, h as (select question, coalesce(c.seite, c.seite_pdf) s, min(r) r from b join chunks c on c.id = b.id where r <= {K} and coalesce(c.seite, c.seite_pdf) is not null group by 1, 2)
select question, string_agg(s, ',' order by r) seiten from h group by 1
"""


def context_blocks(spark, d: str) -> DataFrame:
    """Context of every golden question: its four best chunks as blocks with a source head; its length and hash."""
    c = table(spark, d, "chunks").select("id", "text", "buch_id", F.coalesce("seite", "seite_pdf").alias("seite"))
    h = R.bm25(_questions(spark, d), _corpus(spark, d), 4).join(c, "id")
    head = F.concat_ws(", Seite ", F.coalesce("buch_id", F.lit("?")), F.coalesce(F.col("seite").cast("string"), F.lit("?")))
    return R.context(h, ["question"], "rank", head, "text").select("question", F.length("kontext").alias("zeichen"), F.md5("kontext").alias("hash"))


CONTEXT_SQL = f"""
with {_BM25}, h as (select question, r, '[' || coalesce(c.buch_id, '?') || ', Seite ' || coalesce(cast(coalesce(c.seite, c.seite_pdf) as varchar), '?') || ']' || chr(10) || coalesce(c.text, '') t from b join chunks c on c.id = b.id where r <= 4),
k as (select question, string_agg(t, chr(10) || chr(10) order by r) k from h group by 1)
select question, length(k) zeichen, md5(k) hash from k
"""

QUERIES = {
    "topk_path_compare": topk_path_compare, "tie_group_compare": tie_group_compare, "hit_pages": hit_pages, "context_blocks": context_blocks,
    "vector_topk": vector_topk, "l2_normalize": l2_normalize, "chunk_windows": chunk_windows, "drop_types_null_kept": drop_types_null_kept,
    "filtered_books": filtered_books, "query_terms": query_terms, "term_postings": term_postings, "bm25_topk": bm25_topk,
    "hybrid_topk": hybrid_topk, "rerank_overlap": rerank_overlap,
}
SQL = {
    "vector_topk": VECTOR_SQL, "l2_normalize": L2_SQL, "chunk_windows": WINDOWS_SQL, "drop_types_null_kept": DROP_SQL, "filtered_books": BOOKS_SQL,
    "query_terms": TERMS_SQL, "term_postings": POSTINGS_SQL, "bm25_topk": BM25_SQL, "hybrid_topk": HYBRID_SQL,
    "topk_path_compare": PATH_SQL, "tie_group_compare": TIE_SQL, "rerank_overlap": RERANK_SQL, "hit_pages": PAGES_SQL, "context_blocks": CONTEXT_SQL,
}
