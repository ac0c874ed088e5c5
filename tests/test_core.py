import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import chunking as C
from groundwork.operators import index as I
from groundwork.operators import measuring as M
from groundwork.operators import ranking as R
from groundwork.plans import registry

DATA = "/root/testdata/sf0.001"


def values(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def plain(df):
    def one(x):
        if x is None or not isinstance(x, str) and pd.isna(x):
            return "-"
        return round(float(x), 5) if isinstance(x, float) or "float" in type(x).__name__ else str(x)

    df = df[sorted(df.columns)]
    return sorted([tuple(one(x) for x in r) for r in df.itertuples(index=False)], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_windows(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string")
    assert values(C.chunk_windows(d, size=4, overlap=1), "id", "piece_no", "start", "piece") == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (1, 3, 9, "j")]
    with pytest.raises(ValueError):
        C.chunk_windows(d, size=3, overlap=3)


def test_blocks_and_pages(spark):
    d = spark.createDataFrame([("aaa\n\nbb\n\ncccc",)], "t string")
    assert d.select(C.paragraph_blocks(F.col("t"), 5)).first()[0] == ["aaa\n\nbb", "cccc"]
    breaks = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(p).alias("page")) for o, p in ((0, 4), (100, 5))])
    d = spark.range(1)
    assert d.select(C.spanned_pages(F.lit(80), F.lit(120), breaks)).first()[0] == [4, 5]
    assert d.select(C.spanned_pages(F.lit(100), F.lit(120), breaks)).first()[0] == [5]


def test_fusion(spark):
    a = spark.createDataFrame([("q", i, r) for r, i in enumerate([0, 1, 2], 1)], "question string, id int, rank int")
    b = spark.createDataFrame([("q", i, r) for r, i in enumerate([2, 0], 1)], "question string, id int, rank int")
    assert [r.id for r in R.fused([a, b], 9).orderBy("rank").collect()] == [0, 2, 1]
    a = spark.createDataFrame([("q", 5, 1), ("q", 7, 2)], "question string, id int, rank int")
    b = spark.createDataFrame([("q", 7, 1), ("q", 5, 2)], "question string, id int, rank int")
    assert [r.id for r in R.fused([a, b], 9).orderBy("rank").collect()] == [5, 7]


def test_ties_take_the_lower_position(spark):
    d = spark.createDataFrame([("q", p, 0.9 if p in (20, 41) else 0.5) for p in range(42)], "q string, pos int, s double")
    assert [r.pos for r in R.ranked(d, ["q"], "s", ["pos"], 5).orderBy("rank").collect()] == [20, 41, 0, 1, 2]


def test_null_types_are_kept(spark):
    d = spark.createDataFrame([(1, "flavor "), (2, None), (3, "regel")], "id int, typ string")
    assert values(R.drop_types(d, ["flavor", "meta"]), "id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        R.equal_to(d, nichts=1)


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.slug(F.lit("Bärengilde – Söhne & Co."))) == "baerengilde-soehne-co"
    assert one(T.slug(F.lit("–"))) is None
    assert one(T.name_key(F.lit("Food_Truck: Groß!"))) == "foodtruckgross"
    assert one(T.query_terms(F.lit("Geld? Geld!"))) == ["geld"]
    assert one(T.last_verdict(F.lit("<think>URTEIL: falsch</think>\nURTEIL: teilweise\nUrteil = **richtig**"))) == "richtig"
    assert one(T.last_verdict(F.lit("nichts"))) == "unparsebar"
    assert one(T.class_of_reply(F.lit("Kein Regelinhalt, sondern flavor."))) == "flavor"
    assert one(T.class_of_reply(F.lit("Das ist nicht meta, sondern regel"))) == "regel"
    assert one(T.class_of_reply(F.lit("weiß nicht"))) == "regel"
    assert one(T.dehyphenated(F.array(*map(F.lit, ["Der Spiel-", "stein und Ein-", "und Aus­", "gang A-", "B"]))))[0] == "Der Spielstein und Ein- und Ausgang A-B"
    assert one(T.keyword_hits(F.lit("Die blauen Steinen"), F.array(F.lit("blau"), F.lit("blauen Stein"), F.lit("")))) == ["blauen Stein"]
    assert one(T.similarity(F.lit("Fujian"), F.lit("Fuji"))) == pytest.approx(0.8)


def test_measuring(spark):
    rows = [("s", "richtig", 1.0), ("s", "falsch", 2.0), ("s", "unsicher", 3.0), ("s", "unparsebar", 40.0), ("t", "unsicher", -1.0)]
    d = spark.createDataFrame(rows, "setting string, urteil string, sekunden double")
    got = {r.setting: r for r in M.run_counts(d, "setting").collect()}
    assert (got["s"].median_s, got["s"].max_s, got["s"].treffsicherheit) == (2.5, 40.0, pytest.approx(1 / 3, abs=1e-6))
    assert got["t"].treffsicherheit is None and got["t"].median_s is None
    a = spark.createDataFrame([(1, "falsch"), (1, "unsicher"), (2, "richtig"), (2, "richtig"), (3, "falsch"), (3, "unparsebar")], "q int, urteil string")
    b = spark.createDataFrame([(1, "richtig"), (1, "teilweise"), (2, "falsch"), (2, "falsch"), (3, "richtig"), (3, "richtig")], "q int, urteil string")
    assert values(M.directions(a, b, ["q"]), "q", "richtung") == [(1, "verbessert"), (2, "verschlechtert")]
    assert values(M.stable(a, ["q"]), "q", "urteil") == [(2, "richtig")]
    c = spark.createDataFrame([(0.4, True), (0.6, False), (0.95, True)], "p double, ok boolean")
    assert [(r.n, r.treffer) for r in M.confidence_bins(c, "p", "ok").orderBy("bin").collect()] == [(1, 1), (1, 0), (0, 0), (1, 1), (0, 0)]
    assert [(r.eskaliert, r.fehler) for r in M.threshold_curve(c, "p", "ok", (0.5, 0.9)).orderBy("schwelle").collect()] == [(1, 1), (2, 0)]
    w = spark.createDataFrame([("a", 1, 2), ("b", 2, 4), ("c", 0, 0)], "g string, p int, n int")
    assert M.worst(w, "g", "p", "n").first().gruppe == "b"


def test_index_state(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)], "k string, id int, t string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "z"), ("d", 1, "")], "k string, id int, t string")
    got = I.status(I.fingerprints(new, "k", "id", "t"), I.fingerprints(old, "k", "id", "t"), "k")
    assert values(got, "k", "status") == [("a", "aktuell"), ("b", "geaendert"), ("c", "entfernt"), ("d", "neu")]
    once = I.replaced(old, new.where("k = 'b'"), "k", "id")
    assert values(I.replaced(once, new.where("k = 'b'"), "k", "id"), "k", "t") == values(once, "k", "t")
