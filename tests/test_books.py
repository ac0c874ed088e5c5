import difflib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import books as B
from groundwork.operators import chat as H
from groundwork.operators import index as I
from groundwork.operators import judging as J
from groundwork.operators import layout as L
from groundwork.operators import names as N
from groundwork.operators import ranking as R
from groundwork.sources import files, sinks
from groundwork.streaming import chats, tokens


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_edition_rule(spark):
    c = spark.createDataFrame([(i, "s", k, e) for i, (k, e) in enumerate([("regel", "alpha"), ("regel", "beta"), ("regel", "gamma"), ("faq", "gamma"), (None, "gamma"), ("regel", None)])], "id int, spiel_id string, art string, fassung string")
    rules = spark.createDataFrame([("s", "regel", ["alpha"], {"beta": "alt"})], "spiel_id string, art string, authoritative array<string>, annotated map<string,string>")
    got = {r.id: r.hinweis for r in B.with_edition_rule(c, rules, "spiel_id", "art", "fassung").collect()}
    assert got == {0: None, 1: "alt", 3: None, 4: None}
    assert B.with_edition_rule(c, rules.limit(0), "spiel_id", "art", "fassung").count() == 6


def test_kind_by_prefix(spark):
    c = spark.createDataFrame([(1, "s", ["A", "B", "C"]), (2, "s", ["A"]), (3, "s", []), (4, "s", None), (5, "t", ["A"])], "id int, s string, p array<string>")
    rules = spark.createDataFrame([("s", 0, ["A"], "eins"), ("s", 1, ["A", "B"], "zwei"), ("s", 2, ["A", "B"], "drei")], "s string, rule_no int, prefix array<string>, kind string")
    assert {r.id: r.kind for r in B.kind_by_prefix(c, rules, "id", ["s"], "p", F.lit("grund")).collect()} == {1: "zwei", 2: "eins", 3: "grund", 4: "grund", 5: "grund"}


def test_citations(spark):
    assert one(spark, B.citation(F.lit("Buch"), F.lit("2"), F.lit(7), F.lit(9), F.lit(None).cast("string"))) == "Buch (2), S. 7"
    assert one(spark, B.citation(F.lit("Buch"), F.lit("2"), F.lit(None).cast("int"), F.lit(9), F.lit("alt"), True)) == "Buch (2), PDF-Seite 9 (alt)"
    assert one(spark, B.page_list(F.array(F.lit(3), F.lit(9), F.lit(1)), True)) == "Seite 3, Seite 9 und Seite 1"
    assert one(spark, B.page_list(F.array().cast("array<int>"), True)) == ""


def test_section_chunks(spark):
    s = spark.createDataFrame([("b", 1, ["K", "U"], "x" * 401, [(0, 4), (300, 5)]), ("b", 2, [], "kurz", []), ("b", 3, [], "", [])], "b string, id int, pfad array<string>, text string, umbrueche array<struct<offset:int,page:int>>")
    got = B.section_chunks(s, ["b"], "id", 400, 150).orderBy("pos").collect()
    assert [(r.pos, r.start, r.seite, r.seiten) for r in got] == [(0, 0, 4, [4, 5]), (1, 250, 4, [4, 5]), (2, 0, None, [])]
    assert got[0].text.startswith("K › U\nx") and got[2].text == "kurz"


def test_names(spark):
    def resolve(asked, names):
        c = spark.createDataFrame([(n, a) for n, a in names], "name string, aliase array<string>")
        return {r.anfrage: (r.art, r.namen) for r in N.resolved(spark.createDataFrame([(x,) for x in asked], "anfrage string"), N.catalogue(c, "name", "aliase")).collect()}

    two = resolve(["Fujian", "Fujix", "FUJI!", "", None, "Food Chain Magnet"], [("FCM", ["Food Chain Magnate"]), ("Fuji", None)])
    assert two["Fujian"] == ("unbekannt", []) and two["Fujix"] == ("treffer", ["Fuji"]) and two["FUJI!"] == ("treffer", ["Fuji"]) and two[""] == ("unbekannt", [])
    assert two["Food Chain Magnet"] == ("treffer", ["FCM"])
    alone = resolve(["Food Chai"], [("Food Chain Magnate", None)])
    assert alone["Food Chai"] == ("unbekannt", ["Food Chain Magnate"])
    both = resolve(["gleich", "gleicx"], [("A", ["gleich"]), ("B", ["gleich"])])
    assert both["gleich"] == ("unbekannt", ["A", "B"]) and both["gleicx"][0] == "unbekannt"


def resolved_plainly(asked, names):
    """The rule of ``resolved``, every key asked against every spelling (``names``: sets of spellings by name)."""
    out, several = {}, len(names) > 1
    for n in asked:
        if exact := sorted(x for x, forms in names.items() if n in forms):
            out[n] = ("treffer" if len(exact) == 1 else "unbekannt", exact)
            continue
        hits, guesses = {}, {}
        for x, forms in names.items():
            for f in forms:
                r, length = difflib.SequenceMatcher(None, n, f, autojunk=False).ratio(), min(len(n), len(f)) / max(len(n), len(f))
                if r >= N.HIT and (not several or length >= N.LENGTHS):
                    hits[x] = max(r, hits.get(x, 0))
                if r >= (N.SUGGEST if several else N.SUGGEST_ALONE) and (not several or length >= N.SUGGEST_LENGTHS):
                    guesses[x] = max(r, guesses.get(x, 0))
        close = {x: r for x, r in hits.items() if max(hits.values()) - r < N.CLOSE}
        out[n] = ("treffer" if len(close) == 1 else "unbekannt", sorted(close or guesses, key=lambda x: (-(close or guesses)[x], x)))
    return out


def made_names(r, n, signs, longest):
    parts = ["".join(r.choices(signs, k=r.randint(1, longest))) for _ in range(9)]
    return {f"Name {i}": {"".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(1, 3))} for i in range(n)}


@pytest.mark.parametrize("n, signs, longest", [(60, "abc", 5), (60, "abcdefgh日é𠀀", 9), (40, "abcdefgh", 40), (1, "abc", 5)])
def test_names_as_compared_plainly(spark, monkeypatch, n, signs, longest):
    monkeypatch.setattr(N, "LEAST_ASKED", 20)
    r = random.Random(n + longest)
    names = made_names(r, n, signs, longest)
    forms = sorted(f for x in names.values() for f in x)
    asked = {"z"}
    for f in forms + r.choices(forms, k=30):
        i = r.randrange(len(f))
        asked |= {f, f[:i] + f[i + 1 :] or "z", f[:i] + r.choice(signs) + f[i:], f[: r.randint(1, len(f))]}
    c = spark.createDataFrame([(x, f) for x, y in names.items() for f in y], "name string, form string")
    # spellings in several blocks too
    monkeypatch.setattr(N.alike, "__defaults__", (None, 25))
    got = {x.anfrage: (x.art, x.namen) for x in N.resolved(spark.createDataFrame([(x,) for x in asked], "anfrage string"), c).collect()}
    assert got == resolved_plainly(asked, names)


def test_common_subsequences():
    r = random.Random(5)

    def plainly(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    forms = ["".join(r.choices("abcd日", k=k)) for k in [1, 1, 2, 5, 9, 63, 64, 65, 130]]
    held = N.Spellings(forms)
    for k in [1, 2, 9, 63, 64, 65, 130]:
        n = "".join(r.choices("abcdx", k=k))
        assert held.common(n, 0, len(forms)).tolist() == [plainly(n, f) for f in held.forms]
        assert held.common(n, 3, 7).tolist() == [plainly(n, f) for f in held.forms[3:7]]


def test_names_of_a_large_catalogue(spark):
    heads = ["".join(x) for x in zip(*[iter("abendbergdorfeicheforstgartenhafeninselklosterlaternemondnebelsonnewaldwolke")] * 3)]
    ends = [" am Fluss", " für Zwei", " – Die Rückkehr", ": Aufbruch", " der Gilden"]
    names = [f"{a}{b}{c}{e}" for a in heads for b in heads for c in ("wacht", "pfad") for e in ends][:4000]
    c = N.catalogue(spark.createDataFrame([(x, None) for x in names], "name string, aliase array<string>"), "name", "aliase")
    began = time.time()
    got = N.resolved(spark.createDataFrame([(x[:3] + x[4:],) for x in names], "anfrage string"), c).collect()
    assert len(got) == len({x[:3] + x[4:] for x in names}) and all(x.namen for x in got)
    # not ended after 200 s when all spellings of about the same length were compared
    assert time.time() - began < 60


def test_judging(spark):
    rows = [("s1", "falsch", "richtig", "a"), ("s1", "falsch", "richtig", "b"), ("s1", "falsch", "falsch", "a"), ("s2", "falsch", "falsch", None), ("s2", "falsch", "unsicher", None), ("s1", "richtig", "falsch", None), ("s1", "richtig", "richtig", None)]
    d = spark.createDataFrame(rows, "spiel_id string, label string, urteil string, fehlerart string")
    got = {(r.block, r.ebene, r.gruppe): (r.zaehler, r.nenner) for r in J.rate_blocks(d).collect()}
    assert got["durchgewunken", "gesamt", ""] == (2, 5) and got["durchgewunken", "spiel", "s1"] == (2, 3) and got["durchgewunken", "fehlerart", "-"] == (0, 2) and got["abgelehnt", "gesamt", ""] == (1, 2)
    assert {r.name: r.quote for r in J.unsure_split(d).collect()}["unsicher_als_falsch"] is None
    tok = lambda *x: F.array(*[F.struct(F.lit(t).alias("token"), F.log(F.lit(p)).alias("logprob")) for t, p in x])
    shares = J.option_shares(tok(("A", 0.4), (" C", 0.3), ("c)", 0.2), ("C.", 0.1)), J.OPTIONS)
    assert one(spark, J.best_option(shares, J.OPTIONS, "A")) == "C" and one(spark, shares)["C"] == pytest.approx(0.6)
    assert one(spark, J.best_option(J.option_shares(tok(("x", 0.4)), J.OPTIONS), J.OPTIONS, "A")) == "A" and one(spark, J.option_shares(tok(("x", 0.4)), J.OPTIONS)) is None
    assert one(spark, J.best_option(J.option_shares(tok(("A", 0.4), ("B", 0.4)), J.OPTIONS), J.OPTIONS)) == "A"
    fixed = ["In den gefundenen Stellen steht das nicht eindeutig. Schau auf Seite 3 und 4 nach.", "In den gefundenen  Stellen steht dazu nichts. Nächste Fundstellen: S. 1, S. 2.", "In den gefundenen Stellen steht dazu nichts. Doch: ja."]
    assert [one(spark, J.is_fixed_refusal(F.lit(x))) for x in fixed] == [True, True, False]
    assert one(spark, J.composed_answer(F.lit("C"), F.lit("x"), F.array(F.lit(3), F.lit(9)))) == "In den gefundenen Stellen steht dazu nichts. Naechste Fundstellen: S. 3, S. 9."
    o = spark.createDataFrame([(0, "richtig", None)], "zeile bigint, neu string, fehlerart string")
    lines = spark.createDataFrame([(0, "falsch", "a"), (1, "falsch", "b")], "zeile bigint, label string, fehlerart string")
    assert [(r.label, r.label_original, r.fehlerart) for r in J.with_overrides(lines, o).orderBy("zeile").collect()] == [("richtig", "falsch", None), ("falsch", None, "b")]
    for bad in ([(5, "richtig", None)], [(0, "richtig", None), (0, "falsch", None)], [(0, "gut", None)]):
        with pytest.raises(ValueError):
            J.with_overrides(lines, spark.createDataFrame(bad, o.schema))
    runs = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("A", 1, 2)], "setting string, lauf int, q int")
    assert [tuple(r) for r in J.unequal_runs(runs, "setting", "lauf", ["q"]).collect()] == [("A", 2, 1)]


def test_classes_of_replies(spark):
    table = {"regel": "regel", "Flavor": "flavor", "flavor-Text": "flavor", "Spielregel": "regel", "ohne flavor, meta": "regel", "ohne flavor, also nur meta": "meta", "anstatt meta": "regel", "flavor oder meta": "regel", "<think>meta</think>\nflavor": "flavor", "nicht nur flavor": "regel", "Lang.\nmeta": "meta", "": "regel"}
    assert {k: one(spark, T.class_of_reply(F.lit(k))) for k in table} == table


def test_lines(spark):
    r = one(spark, T.dehyphenated(F.array(*map(F.lit, ["Nah-", "und Fernkampf", "Akti-", "onswürfel", "ED4-", "Regeln", "Zwerg-", "Krieger", "Stufen/", "Würfel", "Wei­ch­", "heit"]))))
    assert (r.text, r.verbunden, r.behalten) == ("Nah- und Fernkampf Aktionswürfel ED4-Regeln Zwerg-Krieger Stufen/Würfel Weichheit", 2, 3)
    assert one(spark, T.dehyphenated(F.array(F.lit("von A-"), F.lit("bis Z")))).text == "von A- bis Z"
    assert [one(spark, T.deletions(F.lit(a), F.lit(b))) for a, b in (("Kmpf", "Kampf"), ("Kampfregl", "Kampfregel"), ("KAMPF REGELN", "Kampfregeln"), ("Kampfregelnx", "Kampfregeln"), ("", "Kampfregeln"))] == [None, 1, 0, None, None]
    assert one(spark, T.font_style(F.lit("ABC+Times-BoldSC"))).asDict() == {"fett": True, "kursiv": False, "kapitaelchen": True}
    assert one(spark, T.without_footer(F.lit("Ja.\n\nHinweis: nur teilweise belegt -- pruef S. 3.\n\n---\n*Abgerufen: Seite 3*"))) == "Ja."
    assert one(spark, T.named_values(F.lit("- Turm: 3\n* ab\n12. Tor: groß\na: b"))) == ["Turm: 3", "Tor: groß"]
    assert [one(spark, T.page_of_name(F.lit(n), F.lit(g).cast("int"))) for n, g in (("seite_12.png", None), ("seite_12.png", 3), ("bild.png", None), ("seite_0.png", None))] == [12, 3, None, None]
    assert one(spark, T.without_politeness(F.lit("Azul bitte danke"))) == "Azul" and one(spark, T.without_politeness(F.lit("bitte"))) == "bitte"


def test_layout(spark):
    font = lambda size, bold: F.struct(F.lit(size).alias("groesse"), F.lit(bold).alias("fett"), F.lit(False).alias("kursiv"), F.lit(False).alias("kapitaelchen"), F.lit(0.0).alias("laufweite"))
    layout = {"stufen": [{"groesse": [13, 15]}, {"fett": True}], "klasse": "section_header"}
    decide = lambda cls, f: one(spark, L.layout_decision(F.lit(cls), F.lit("Titel"), f, layout))
    none = F.lit(None).cast("struct<groesse:double,fett:boolean,kursiv:boolean,kapitaelchen:boolean,laufweite:double>")
    assert [decide("text", font(14.0, True)), decide("text", font(10.0, True)), decide("text", font(10.0, False)), decide("table", font(14.0, True)), decide("section_header", none), decide("section_header", font(10.0, False))] == [1, 2, None, None, 1, None]
    assert [one(spark, L.in_margin(F.lit(t), F.lit(b), F.lit(800.0), 30.0, 60.0)) for t, b in ((20.0, 40.0), (21.0, 41.0), (730.0, 750.0), (None, 1.0))] == [True, False, True, None]
    h = spark.createDataFrame([("d", 1, "A", 1), ("d", 2, "B", 3), ("d", 3, "C", 2), ("d", 4, "D", 1)], "d string, n int, t string, e int")
    assert [r.pfad for r in L.heading_paths(h, ["d"], "n", "t", "e").orderBy("n").collect()] == [["A"], ["A", "B"], ["A", "C"], ["D"]]
    assert [r.pfad for r in L.open_levels(h, ["d"], "n", "t", "e").orderBy("n").collect()] == [["A"], ["A", "B"], ["A", "C"], ["D"]]
    lines = spark.createDataFrame([("d", 1, 0, "Vorwort"), ("d", 1, 1, "Der Kampf"), ("d", 1, 2, "Würf-"), ("d", 2, 0, "le."), ("d", 2, 1, "Ende")], "doc_id string, page int, line_no int, text string")
    heads = spark.createDataFrame([("d", 1, "Der Kampf", 1, 1), ("d", 2, "Fehlt", 2, 1), ("d", 3, "Ende", 1, 2)], "doc_id string, entry_no int, titel string, ebene int, page int")
    f = L.found_headings(lines, heads)
    assert [(r.line_no, r.gefunden) for r in f.orderBy("entry_no").collect()] == [(1, True), (2, False), (1, True)]
    p = f.join(L.heading_paths(heads, ["doc_id"], "entry_no", "titel", "ebene"), ["doc_id", "entry_no"])
    assert [(r.pfad, r.text, r.seiten) for r in L.sections(lines, p).orderBy("abschnitt_nr").collect()] == [(["Vorspann"], "Vorwort", [1]), (["Der Kampf"], "", [1]), (["Der Kampf", "Fehlt"], "Würfle.", [1, 2]), (["Ende"], "", [2])]


def test_chats(spark):
    names = H.Names([("Azul", "Azul"), ("7 Wonders: Duel", "7 Wonders: Duel"), ("Brass A", "Brass"), ("Brass B", "Brass")])
    say = lambda *x: H.decision([("assistant" if t.startswith((H.ASKS, H.UNKNOWN, "Gut")) else "user", t) for t in x], names)
    assert say("Wer beginnt?") == ("frage", [], 0, None)
    assert say("Spiel: Azul") == ("gewechselt", ["Azul"], None, None)
    assert say("Spiel: 7 Wonders: Duel bitte: wer beginnt?") == ("frage", ["7 Wonders: Duel"], 0, "wer beginnt?")
    assert say("Spiel: Azul", "Gut.", "Wer beginnt?") == ("frage", ["Azul"], 2, None)
    assert say("Wer beginnt?", H.ASKS, "für Azul") == ("frage", ["Azul"], 0, None)
    assert say("Wer beginnt?", H.ASKS, "Azul natürlich", H.UNKNOWN + "x“", "azul") == ("frage", ["Azul"], 0, None)
    assert say("Spiel: Brass")[0:2] == ("mehrdeutig", ["Brass A", "Brass B"])
    assert say("Spiel: Azul", "Gut.", "Spiel: Unbekannt")[0] == "unbekannt"
    assert say("Wer beginnt?", H.ASKS, "Und wie endet es?") == ("frage", [], 2, None)
    m = spark.createDataFrame([("c", 0, "user", "Spiel: Azul"), ("c", 1, "assistant", "Gut."), ("c", 2, "user", "Wer?"), ("d", 0, "system", "x")], "conv_id string, turn int, role string, text string")
    forms = spark.createDataFrame([("Azul", "Azul")], "name string, form string")
    assert {r.conv_id: (r.art, r.namen, r.turn) for r in H.decide_chats(m, forms).collect()} == {"c": ("frage", ["Azul"], 2), "d": ("frage", [], None)}
    s = {r.conv_id: (r.frage, [tuple(x) for x in r.verlauf]) for r in H.split_history(m).collect()}
    assert s == {"c": ("Wer?", [("user", "Spiel: Azul"), ("assistant", "Gut.")]), "d": ("", [])}


def test_streams(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for rows in ([[("c", 0, "user", "Spiel: Azul")], [("c", 1, "assistant", "Gut."), ("c", 2, "user", "Wer?")]]):
        seen = []
        spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("conv_id string, turn int, role string, text string").parquet(str(tmp_path / "in"))
        q = chats.decide_streaming(stream, [("Azul", "Azul")]).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == [("c", 2, "frage", ["Azul"], None)]
    d = spark.createDataFrame([('{"message": {"content": "Hal"}}',), ("",), ('{"message": {"content": "lo"}, "done": true}',)], "value string")
    assert [tuple(r) for r in tokens.pieces(d).collect()] == [("Hal", False), ("lo", True)]
    with pytest.raises(Exception, match="voll"):
        tokens.pieces(spark.createDataFrame([('{"error": "voll"}',)], "value string")).collect()


def test_index_steps(spark):
    by = ["s", "b"]
    now = spark.createDataFrame([("s", "a", "1", "x"), ("s", "b", "2", "y"), ("s", "c", "3", "z")], "s string, b string, fingerprint string, deklaration string")
    old = spark.createDataFrame([("s", "a", "1", "x"), ("s", "b", "2", "anders"), ("s", "d", "4", None)], now.schema)
    plan = I.book_plan(now, old, by)
    assert {r.b: r.schritt for r in plan.collect()} == {"a": "behalten", "b": "umschreiben", "c": "einbetten", "d": "loeschen"}
    stored = spark.createDataFrame([("s", k, 0, "alt", [1.0]) for k in "abd"], "s string, b string, pos int, text string, emb array<double>")
    declared = spark.createDataFrame([("s", k, 0, "neu", None if k == "b" else [2.0]) for k in "abc"], stored.schema)
    assert sorted((r.b, r.text, r.emb) for r in I.refreshed(stored, declared, plan, by).collect()) == [("a", "alt", [1.0]), ("b", "neu", [1.0]), ("c", "neu", [2.0])]
    rows = spark.createDataFrame([(i, "x") for i in range(10)], "id bigint, t string").withColumn("k", F.lit("g"))
    assert I.fingerprints(rows, "k", "id", "t", bucket=3).first().n_chunks == 10
    assert I.fingerprints(rows, "k", "id", "t", bucket=3).first().fingerprint == I.fingerprints(rows.repartition(4), "k", "id", "t", bucket=3).first().fingerprint


def test_ranking_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(5)
    c = spark.createDataFrame([(i, i % 50, "s" if i % 3 else "t", " ".join(r.choices("rot blau turm tor geld karte".split(), k=6)), [r.random(), r.random()]) for i in range(120)], "id bigint, pos int, collection string, text string, v array<double>")
    q = spark.createDataFrame([(f"q{i}", "s", " ".join(r.choices("rot blau turm fehlt".split(), k=3)), [r.random(), r.random()]) for i in range(30)], "question string, collection string, frage string, q array<double>")
    rows = lambda df: sorted((x.question, x.rank, x.id, round(x.score, 6)) for x in df.collect())
    whole = rows(R.bm25(q, c, 5)), rows(R.vector_topk(q, c, "collection", 5))
    assert whole[1] == rows(R.pairwise_topk(q, c, "collection", 5))
    grid = R.gridded
    monkeypatch.setattr(R, "gridded", lambda a, b, f, **more: grid(a, b, f, block=7, **more))
    assert (rows(R.bm25(q, c, 5)), rows(R.vector_topk(q, c, "collection", 5))) == whole
    assert R.bm25(q.limit(0), c, 5).count() == 0 and R.hybrid(q, c.limit(0), 5).count() == 0


def test_files(spark, tmp_path):
    def put(path, rows):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(rows if isinstance(rows, str) else "\n".join(json.dumps(r) for r in rows))

    root = str(tmp_path / "daten")
    put(f"{root}/azul/spiel.json", json.dumps({"spiel_id": "azul", "name": "Azul", "buecher": [{"buch_id": "grund", "fassung": "1"}]}))
    put(f"{root}/azul/wissen.jsonl", json.dumps({"id": 1, "seite": 3, "text": "x", "spiel_id": "azul", "extra": 1}) + "\n\n")
    put(f"{root}/azul/golden_set.json", json.dumps({"spiel_id": "azul", "fragen": [{"id": 1, "frage": "Wer?", "seiten": [3]}]}))
    put(f"{root}/Kein Name/spiel.json", json.dumps({"spiel_id": "x", "name": "x"}))
    assert [r.spiel_id for r in files.collections(spark, root).collect()] == ["azul"]
    assert files.entries(spark, root).count() == 1 and files.golden_questions(spark, root).first().seiten == [3]
    with pytest.raises(ValueError):
        files.golden_questions(spark, root, "../golden_set.json")
    put(f"{root}/azul/wissen.jsonl", [{"id": 1, "seite": 3, "text": "x", "spiel_id": "anderes"}])
    with pytest.raises(ValueError, match="another collection"):
        files.entries(spark, root)
    v = str(tmp_path / "urteile.jsonl")
    put(v, [{"spiel_id": "s", "frage_id": 1, "urteil": "richtig"}] * 2)
    with pytest.raises(ValueError, match="twice"):
        files.run_verdicts(spark, v)
    e = str(tmp_path / "eich.jsonl")
    put(e, [{"spiel_id": "s", "frage_id": 1, "label": "richtig"}, {"spiel_id": "s", "frage_id": 2, "label": "falsch"}])
    assert [(r.zeile, r.label) for r in files.calibration(spark, e).orderBy("zeile").collect()] == [(0, "richtig"), (1, "falsch")]
    put(e, [{"spiel_id": "s", "frage_id": 1, "label": "gut"}])
    with pytest.raises(ValueError, match="unknown labels"):
        files.calibration(spark, e)
    a = spark.createDataFrame([("s", 1, "x")], "spiel_id string, frage_id int, antwort string")
    with pytest.raises(ValueError, match="not in the golden set"):
        files.answers_with_questions(a, spark.createDataFrame([("s", 2)], "spiel_id string, frage_id int"))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("k", "s", 1, "x"), ("k", "t", 2, None)], "konfig string, spiel_id string, id int, text string")
    at = str(tmp_path / "einmal")
    assert [sinks.write_once(d, at), sinks.write_once(d.repartition(3), at)] == ["geschrieben", "unveraendert"]
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(d.limit(1), at)
    os.symlink(at, tmp_path / "verweis")
    with pytest.raises(ValueError, match="symbolic link"):
        sinks.write_json_lines(d, str(tmp_path / "verweis" / "x"))
    index = str(tmp_path / "index")
    sinks.rewrite_collections(d, index)
    sinks.rewrite_collections(d.where("spiel_id = 's'").withColumn("text", F.lit("neu")), index)
    assert sorted((r.spiel_id, r.text) for r in spark.read.parquet(index).collect()) == [("s", "neu"), ("t", None)]
    assert sinks.drop_collections(spark, index, d.where("spiel_id = 't'")) == 1
    assert [r.spiel_id for r in spark.read.parquet(index).collect()] == ["s"]
    sinks.replace_whole(d.limit(1), at)
    assert spark.read.parquet(at).count() == 1
    run = sinks.write_run(d, str(tmp_path), "lauf1", {"modell": "m"})
    with pytest.raises(ValueError, match="already"):
        sinks.write_run(d, str(tmp_path), "lauf1", {})
    sinks.write_verdicts(d, run, "p1")
    old = spark.createDataFrame([("a", "n", None), ("b", "m", 1)], "k string, name string, x int")
    new = spark.createDataFrame([("a", None, 5), ("c", "neu", None)], old.schema)
    assert sorted((r.k, r.name, r.x) for r in sinks.upserted(old, new, "k", {"x": 0}).collect()) == [("a", "n", 5), ("b", "m", 1), ("c", "neu", 0)]
    assert "konfig" in sinks.report(d, "Bericht")
