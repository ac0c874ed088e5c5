import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import consensus, leakage, near_duplicates, neighbours, ocr, pairs, pieces, sentences, tokens, topn

CHUNKS = "id bigint, spiel_id string, pos int, seite int, seite_pdf int, sprache string, text string, emb array<float>"
ANSWERS = "antwort_id bigint, spiel_id string, frage_id int, frage string, antwort string, abgerufen_id array<bigint>, scores array<double>"


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=str)


def test_top_n_ties_nulls_and_repeats(spark):
    chunks = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, "b", 1)], "id bigint, spiel_id string, pos int")
    answers = spark.createDataFrame(
        [(10, [1, 2, 3], [0.5, 0.5, 0.9]), (10, [1, 2, 3], [0.5, 0.5, 0.9]), (11, [2, None, 1], [0.5, 0.9, float("nan")]), (12, [1], None), (13, [4, 4], [0.1, 0.1]), (None, [1], [9.0])],
        "antwort_id bigint, abgerufen_id array<bigint>, scores array<double>",
    )
    got = rows(topn.best_retrieved(chunks, answers, 2), "spiel_id", "rang", "antwort_id", "stelle")
    assert got == [("a", 1, 10, 1), ("a", 2, 11, 0), ("b", 1, 13, 0), ("b", 2, 13, 1)]
    assert topn.best_retrieved(chunks.limit(0), answers.limit(0)).count() == 0


def test_top_n_equals_sort(spark):
    r = random.Random(3)
    data = [(r.choice("aaaab"), r.randint(0, 20) / 4, i) for i in range(3000)]
    d = spark.createDataFrame(data, "g string, s double, i int").repartition(7)
    got = rows(topn.top_n(d, ["g"], [("s", False), ("i", True)], 5), "g", "rank", "i")
    want = [(g, k, x[2]) for g in "ab" for k, x in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))[:5], 1)]
    assert got == sorted(want, key=str)


def test_consensus_trusts_reliable_judges(spark):
    r = random.Random(5)
    labels, data, truth = consensus.LABELS, [], {}
    for q in range(300):
        truth[q] = r.choice(labels)
        for j in range(7):
            good = r.random() < 0.92
            # judges 4 to 6 always say the same
            data.append(("s", q, f"j{j}", labels[0] if j > 3 else truth[q] if good else r.choice(labels), float(q * 10 + j)))
    d = spark.createDataFrame([(i, *x[:4], None) for i, x in enumerate(data)], "urteil_id bigint, spiel_id string, frage_id int, pruefer string, urteil string, gefaellt timestamp")
    extra = spark.createDataFrame([(9999, "s", 777, "j0", "?", None), (9998, None, 1, "j0", "falsch", None)], d.schema)
    questions, judges = consensus.consensus(d.unionByName(extra))
    got = {x.frage_id: x.urteil for x in questions.collect()}
    assert sum(got[q] == truth[q] for q in truth) > 285
    assert got[777] in labels and len(got) == 301
    trust = {x.pruefer: x.verlaesslichkeit for x in judges.collect()}
    assert min(trust[f"j{k}"] for k in range(4)) > max(trust[f"j{k}"] for k in range(4, 7))
    # the way for many judges gives the same
    joined = consensus.consensus(d.unionByName(extra), broadcast_rows=0)
    assert {x.frage_id: x.urteil for x in joined[0].collect()} == got and {x.pruefer: round(x.verlaesslichkeit, 3) for x in joined[1].collect()} == {k: round(v, 3) for k, v in trust.items()}
    with pytest.warns(RuntimeWarning):
        consensus.consensus(d, rounds=1)
    q, j = consensus.consensus(d.limit(0))
    assert q.count() == 0 and j.count() == 0
    assert consensus.agreement(d.limit(0)).first().alpha is None


def test_pieces(spark):
    texts = ["kurz", None, "", " " * 1300, "x" * 3000, ("wort " * 600).strip(), ("Ein Satz. " * 300).strip(), ("Absatz " * 100 + "\n\n") * 4, "。".join(["字" * 500] * 5)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in pieces.split_oversized(d).collect()}
    assert {k: r.grenze for k, r in got.items()} == {3: "absatz", 4: "hart", 5: "wort", 6: "satz", 7: "absatz", 8: "satz"}
    for k, r in got.items():
        assert all(len(p.stueck) <= 1200 for p in r.stuecke)
        body = "".join(texts[k][p.von : p.bis] for p in r.stuecke)
        assert "".join(body.split()) == "".join(texts[k].split())
        for a, b in zip(r.stuecke, r.stuecke[1:]):
            lead = b.stueck[:60]
            assert lead in a.stueck + texts[k][a.bis : b.von]


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 32))
    x = (centres[r.integers(0, 12, 1500)] + 0.4 * r.standard_normal((1500, 32))).astype(np.float32)
    x[7] = x[6]
    data = [(i, "g" if i < 1300 else "h", v.tolist()) for i, v in enumerate(x)] + [(5000, "g", None), (5001, "g", [0.0] * 32), (5002, "g", [1.0]), (5003, "g", [float("nan")] * 32)]
    d = spark.createDataFrame(data, "id bigint, spiel_id string, emb array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for lo, hi in ((0, 1300), (1300, 1500)):
        s = u[lo:hi] @ u[lo:hi].T
        np.fill_diagonal(s, -2)
        fifth = np.sort(s, axis=1)[:, -5]
        want |= {(int(a) + lo, int(b) + lo) for a, b in zip(*np.nonzero(s >= fifth[:, None] - 1e-6))}
    exact = {tuple(r) for r in neighbours.nearest(d).collect()}
    assert len(exact & want) >= 0.995 * len(want) and not any(a >= 5000 or b >= 5000 for a, b in exact)
    cells = {tuple(r) for r in neighbours.nearest(d, whole=400, cell=100, probes=6, block=200).collect()}
    assert len(cells & want) >= 0.9 * len(want)
    assert neighbours.nearest(d.limit(0)).count() == 0


def test_neighbours_of_large_games_are_all_found(spark):
    # hardly any clusters, and far more cells than are probed first
    x = np.random.default_rng(8).standard_normal((3000, 32)).astype(np.float32)
    d = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id bigint, spiel_id string, emb array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= fifth[:, None] - 1e-6))}
    options = {"whole": 400, "cell": 50, "probes": 3, "block": 700}
    assert {tuple(r) for r in neighbours.nearest(d, **options).collect()} == want
    assert {tuple(r) for r in neighbours.nearest(d, **options, part=1100).collect()} == want


def test_neighbours_of_queries_far_from_the_first_cells_are_found_with_few_comparisons(monkeypatch):
    # narrow clusters have the cells nearest to any query; those of wide ones are none of them
    r = np.random.default_rng(4)
    spread = np.repeat([0.02, 0.02, 0.12, 0.12, 0.12, 0.12], 1000)
    x = np.repeat(r.standard_normal((6, 32)) / 32**0.5, 1000, axis=0) + spread[:, None] * r.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    compared, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, *of: (compared.append(len(of[0])) if spec == "nd,nd->n" else None, einsum(spec, *of))[1])
    every = np.ones(6000, bool)
    a, b, cos = neighbours.search_cells(np.arange(6000), x, every, every, cell=100, probes=4)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= np.sort(s, axis=1)[:, -5:-4] - 1e-6))}
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= want and len(got) >= 0.998 * len(want)
    assert sum(compared) < 100 * 6000


def edited(words, r, share):
    return [r.choice(words) + "x" if r.random() < share else w for w in words]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(400)]
    texts = {}
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(25, 260))]
        for _ in range(r.randint(1, 4)):
            texts[len(texts)] = " ".join(edited(base, r, r.choice([0, 0.02, 0.06, 0.1])))
    texts |= {900: None, 901: "", 902: "zu kurz", 903: texts[0], 904: texts[0]}
    d = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 3 * len(sets[a] & sets[b]) >= len(sets[a]) + len(sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(a, b) for a in sets for b in sets if a < b and root(a) == root(b)}
    g = near_duplicates.near_duplicate_groups(d).collect()
    by = {}
    for x in g:
        by.setdefault(x.root, []).append(x.id)
    got = {(a, b) for m in by.values() for a in m for b in m if a < b}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert near_duplicates.near_duplicate_groups(d.limit(0)).count() == 0


def test_near_duplicates_joined_by_common_text_only(spark):
    # each short text is the common text of its family; the long ones have as much of their own
    texts, families = [], 15
    for f in range(families):
        common = [f"gemein{f}x{k}" for k in range(54)]
        texts.append((len(texts), " ".join(common)))
        for i in range(30):
            texts.append((len(texts), " ".join(common + [f"eigen{f}x{i}x{k}" for k in range(48)])))
    d = spark.createDataFrame(texts, "id bigint, text string")
    want = {(i, i - i % 31) for i in range(31 * families)}
    assert {(r.id, r.root) for r in near_duplicates.near_duplicate_groups(d).collect()} == want
    # the same with lists that are compared in two passes
    assert {(r.id, r.root) for r in near_duplicates.near_duplicate_groups(d, long=5).collect()} == want


def test_components_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="not closed"):
        near_duplicates.components(chain, rounds=1)


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.root for r in near_duplicates.components(e).where("id <= 40").collect()} == {0}


def test_pairs_single(spark):
    words = {w: {"de": -5.0} for w in "was kostet der turm das tor fünf taler am ende ja du darfst".split()} | {w: {"en": -5.0} for w in "the tower costs five coins at end no you may".split()}
    g = pairs.Guess(words, ["de", "en"])
    kind = lambda a, q="Was kostet der Turm?": pairs.describe(a, q, g)
    assert [kind(a)["kind"] for a in (None, "", "​", "...", "**Antwort:** ", "null")] == ["leer"] * 6
    assert [kind(a)["kind"] for a in ("Was kostet der Turm?", "was kostet der turm", "Deine Frage lautet: Was kostet der Turm?")] == ["kopie"] * 3
    assert kind("The tower costs five coins.")["kind"] == "fremdsprache" and kind("塔の値段は五金です。")["kind"] == "fremdsprache"
    assert kind("Fünf Taler.")["kind"] is None and kind("Fünf Taler. Das Tor am")["cut"] and kind("Fünf Taler")["whole"] == "fünf @"
    assert kind("Fünf Taler.", None)["kind"] is None


def test_tokens_round_trip(spark):
    texts = ["", None, "Hallo  Welt\n", "日本語 🧙‍♂️", "<|endoftext|>", "é é", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    e = tokens.encode(d, offsets="stellen")
    for r in tokens.decode(e).collect():
        assert r.decoded == (texts[r.id] or "")
        assert len(r.ids) == len(r.stellen) and (r.ids == []) == (not texts[r.id]) and 50256 not in r.ids
    with pytest.raises(ValueError):
        tokens.encode(d, ids="id")


def test_leaks(spark):
    r = random.Random(1)
    words = [f"{a}{b}" for a in ("wald", "berg", "turm", "gold", "mühle", "see") for b in ("karte", "stein", "lager", "feld", "tor", "boot", "wagen", "ring")]
    p = [r.choice(words) for _ in range(40)]
    noise = lambda n: [r.choice(words) + "n" for _ in range(n)]
    change = lambda w, at: [x if k not in at else "anders" for k, x in enumerate(w)]
    docs = {
        1: noise(50) + p + noise(50), 2: noise(9) + p[10:25] + noise(9), 3: noise(9) + p[10:23] + noise(9), 4: noise(30),
        5: noise(5) + change(p[0:16], {4, 10}) + noise(5), 6: noise(5) + change(p[0:15], {4, 10}) + noise(5), 7: p[3:10] + p[11:30], 8: [w.upper().replace("Ü", "UE") for w in p],
        # fourteen words, and a fifteenth that is altered: fifteen of which one is
        9: noise(9) + p[10:24] + noise(9),
    }
    d = spark.createDataFrame([(k, ", ".join(w)) for k, w in docs.items()] + [(20, None), (21, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, " ".join(p)), (2, None), (3, "zu kurz")], "item_id bigint, text string")
    assert rows(leakage.leaked(d, q)) == [(1, 1), (2, 1), (5, 1), (7, 1), (8, 1), (9, 1)]
    assert rows(leakage.leaked(d, q, block_chars=10)) == [(1, 1), (2, 1), (5, 1), (7, 1), (8, 1), (9, 1)]
    assert leakage.leaked(d, q.limit(0)).count() == 0 and leakage.leaked(d.limit(0), q).count() == 0


def test_leaks_with_long_words_altered(spark):
    p = [f"wo{a}{b}" for a in "abcd" for b in "efgh"]
    p[4], p[11] = "regenbogenfischteichwasser", "tintenfassdeckelgriffbrett"
    doc = [x if k not in (4, 11) else "anders" for k, x in enumerate(p)]
    d = spark.createDataFrame([(1, " ".join(["davor"] * 9 + doc + ["danach"] * 9))], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, " ".join(p))], "item_id bigint, text string")
    assert rows(leakage.leaked(d, q)) == [(1, 1)]


def test_sentences():
    known = sentences.Learned([("abbreviation", "de", "dr"), ("abbreviation", "de", "s"), ("pair", "de", "s #"), ("starter", "de", "das"), ("abbreviation", "de", "z.b")])
    cut = lambda t, lang="de": [x for x in (lambda e: [t[a:b].strip() for a, b in zip([0, *e], e)])(sentences.ends(t, lang, known))]
    assert cut("Das kostet 3.5 Taler. Dr. Wendig weiß es.\n\nTitel\n\n- eins. zwei\n- drei") == ["Das kostet 3.5 Taler.", "Dr. Wendig weiß es.", "Titel", "- eins. zwei", "- drei"]
    assert cut("„Halt! Nicht so schnell!“, rief sie. Siehe S. 14 im\nHeft.") == ["„Halt! Nicht so schnell!“, rief sie.", "Siehe S. 14 im\nHeft."]
    assert cut("“Stop! Not yet!” she cried. Go on.", "en") == ["“Stop! Not yet!” she cried.", "Go on."]
    assert cut("「待って！」と言った。値段は35.5金です。", "wide") == ["「待って！」と言った。", "値段は35.5金です。"]
    assert cut("") == [] and cut("  \n ") == []


def test_sentences_examine_alike_words_once(monkeypatch):
    """A word before a period is examined once, however often it stands there; sums are the same however long they are held raw."""
    calls, plain = [], sentences.before
    monkeypatch.setattr(sentences, "before", lambda *a: calls.append(a) or plain(*a))
    known = sentences.Learned([("abbreviation", "de", "dr"), ("pair", "de", "dr wendig"), ("starter", "de", "das")])
    assert len(sentences.ends("Das Tor bleibt zu. Dr. Wendig kommt.\n" * 300, "de", known)) == 600 and len(calls) <= 3
    long = "Das " + "x" * 200 + "-Dr. Wendig kommt."
    assert sentences.ends(long, "de", known) == [len(long)] and len(sentences.ends(long, "en", known)) == 2
    want = {"n": {"der": 2, "preis": 2, "z": 2, "b": 2, "#": 1, "taler": 1, "zwei": 1, "ende": 1}, "p": {"z": 2, "b": 2, "taler": 1}, "l": {"b": 1, "taler": 1}, "s": {"der": 1, "ende": 1},
            "o": {("z", "b"): 2, ("b", "#"): 1, ("b", "zwei"): 1, ("taler", "der"): 1}}
    for chars in (1, 100, sentences.HELD_CHARS):
        monkeypatch.setattr(sentences, "HELD_CHARS", chars)
        held = sentences.Sums()
        for _ in range(3):
            held.add("Der Preis z. B. 14 Taler. der Preis z. B. zwei! Ende", "de")
        held.fold()
        assert held.sums == {(kind, "de", *(w if kind == "o" else (w, ""))): 3 * n for kind, words in want.items() for w, n in words.items()}


def test_scan_repair():
    known = ocr.Knowledge({"begjnnt": "beginnt"}, {"nord-süd"}, {"@ anleitung"}, {"g\nkapitel # im wald"})
    assert ocr.examine("Kapitel 3 im Wald\nDas Tor ist zu.", 1, "g", known)[0] == ["kopfzeile"] and ocr.examine("Kapitel 3 im Wald\nDas Tor.", 1, "h", known)[0] == []
    text = "WALDREICH · ANLEITUNG    Seite 7\nBegjnnt die Nacht, so nimm die Moor-\nfigur und die Nord-\nSüd-Karte sowie Ein-\nund Ausgang.\n\n– 7 –\nSilber¬\nmünzen gehen."
    kinds, clean = ocr.examine(text, 7, "waldreich-1", known)
    assert kinds == ["kopfzeile", "seitenzahl", "trennung", "zeichen"]
    assert clean == "Beginnt die Nacht, so nimm die Moorfigur und die Nord-Süd-Karte sowie Ein- und Ausgang.\n\nSilbermünzen gehen."
    assert ocr.examine("Kosten:\n6\n7\n8", 7, None, known)[0] == [] and ocr.examine(None, 1, None, known) == ([], "")
    trie = ocr.Trie({"beginnt": (500, "de"), "beginn": (9, "de"), "garden": (900, "en")})
    words = lambda w, *a: [c[2] for c in trie.candidates(w, *a)]
    assert words("begjnnt", 1, "de") == ["beginnt", "beginn"][:1] and words("garder", 1, "fr") == [] and words("beginnt", 1, "de", 0) == []
    trie = ocr.Trie({"beginnt": (500, ""), "spieler": (90, ""), "turm": (50, "")})
    assert words("begknnt") == ["beginnt"] and words("spielr") == ["spieler"] and words("spiteler") == ["spieler"] and words("speler", 2) == ["spieler"] and words("tunn") == []
    assert words("turrn") == ["turm"] and trie.candidates("turrn")[0][0] and not trie.candidates("spielr")[0][0]


def test_automaton_finds_all_within_its_distance():
    r = random.Random(3)
    vocabulary = {"".join(r.choices("abcde", k=r.randint(3, 6))) for _ in range(400)}
    trie = ocr.Trie({w: (1, "") for w in vocabulary})
    for _ in range(60):
        word = "".join(r.choices("abcde", k=r.randint(3, 6)))
        for edits in (1, 2):
            want = {v for v in vocabulary if v != word and ocr.near(v, word, edits)}
            assert want <= {c[2] for c in trie.candidates(word, edits)}


def test_misread_words_by_context(spark):
    """A rare word by an edit of no shape is one only where its neighbours speak for it."""
    r = random.Random(1)
    nouns = ["Turmkarte", "Bergfigur", "Waldlager", "Moorbrunnen"]
    texts = [f"Lege die {r.choice(nouns)} neben das Tor und nimm {r.choice(nouns)} wieder auf" for _ in range(1500)]
    texts += ["Lege die Tuzmkarte neben das Tor", "Dort liegt Bexgfigur herum"]
    d = spark.createDataFrame([(i, "g", 1, None, "de", t) for i, t in enumerate(texts)], "id bigint, spiel_id string, seite int, seite_pdf int, sprache string, text string")
    misread = ocr.learn(d)[0]
    assert misread.get("tuzmkarte") == "turmkarte" and "bexgfigur" not in misread
    with pytest.raises(ValueError, match="LEARNED_ROWS"):
        ocr.bounded(d, "rows", 10)


def answered(n, r):
    """Questions of five kinds in two languages with answers, and 4 % each of refusals, foreign and cut answers."""
    kinds = {"de": [("Was kostet der Turm {}?", "Der Preis beträgt {} Taler."), ("Wer beginnt die Runde {}?", "Das jüngste Mitglied beginnt die Runde {}."), ("Darf ich das Tor {} drehen?", "Ja, du darfst das Tor drehen."),
                    ("Wie viele Karten darf ich ziehen?", "Du darfst pro Runde {} Karten ziehen."), ("Wofür brauche ich das Boot {}?", "Nur für die Wertung {}.")],
             "en": [("What does the tower {} cost?", "The price is {} coins."), ("Who starts the round {}?", "The youngest player starts the round {}."), ("May I turn the gate {}?", "Yes, you may turn the gate."),
                    ("How many cards may I draw?", "You may draw {} cards each round."), ("Why do I need the boat {}?", "Only for the scoring {}.")]}
    no = {"de": "Dazu kann ich leider nichts sagen.", "en": "I cannot answer this from the pages given."}
    out, truth = [], {}
    for i in range(n):
        lang = "de" if r.random() < 0.6 else "en"
        q, a = r.choice(kinds[lang])
        q, allowed, x = q.format(r.randint(1, 90)), r.random() < 0.1, r.random()
        a = a.format(r.randint(1, 90))
        if allowed and x < 0.6:
            a = no[lang]
        elif x < 0.04:
            a, truth[i] = no[lang], "verweigerung"
            if allowed:
                del truth[i]
        elif x < 0.08:
            other = "en" if lang == "de" else "de"
            a, truth[i] = r.choice(kinds[other])[1].format(r.randint(1, 90)), "fremdsprache"
        elif x < 0.12:
            a, truth[i] = a + " " + " ".join(a.split()[:3]) + " und der", "abgeschnitten"
        out.append((i, "g", i, q, a, lang, allowed))
    return out, truth


@pytest.mark.parametrize("n", [600, 6000])
def test_defects_at_two_sizes(spark, n):
    """Foreign answers that recur under many questions stay foreign, however many there are."""
    out, truth = answered(n, random.Random(n))
    answers = spark.createDataFrame([(i, s, f, q, a) for i, s, f, q, a, _, _ in out], "antwort_id bigint, spiel_id string, frage_id int, frage string, antwort string")
    questions = spark.createDataFrame([(s, f, q, ok) for _, s, f, q, _, _, ok in out], "spiel_id string, frage_id int, frage string, erwartet_verweigerung boolean")
    texts = spark.createDataFrame([(q + " " + a, lang) for i, _, _, q, a, lang, _ in out if i not in truth], "text string, lang string")
    got = {r.antwort_id: r.defekt for r in pairs.defects(answers, questions, texts).collect()}
    both = sum(truth.get(k) == v for k, v in got.items())
    assert both >= 0.95 * len(truth) and both >= 0.95 * len(got)


def test_scan_repair_tables(spark):
    d = spark.createDataFrame([(1, None, None, None, None, None), (2, "g", None, 3, "de", "eins\n3"), (2, "g", None, 3, "de", "eins\n3")], "id bigint, spiel_id string, seite int, seite_pdf int, sprache string, text string")
    assert rows(ocr.repaired(d).where(F.size("stoerungen") > 0), "id", "stoerungen") == [(2, ["seitenzahl"]), (2, ["seitenzahl"])]
    assert ocr.repaired(d.limit(0)).count() == 0
