"""Text functions of retrieval and measurement as native column expressions (no Python per row).

Unicode normalisation and Ratcliff/Obershelp similarity have no built-in; they are Arrow-batched
pandas UDFs. Every function returns null for null.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Letters that a decomposition leaves as they are, with their Latin spelling.
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
#: Classes of passages, verdicts and their order.
CLASSES = ("regel", "flavor", "meta")
VERDICTS = ("richtig", "teilweise", "falsch", "unsicher")


def without_marks(c: Column) -> Column:
    """Decomposed text without combining marks (compatibility form)."""

    @pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))

    return strip(c)


def spelled(c: Column) -> Column:
    out = F.lower(c)
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(c: Column) -> Column:
    """Lower case, transliterated, runs of other signs as one dash; null where nothing is left."""
    s = F.trim(F.regexp_replace(without_marks(spelled(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s != "", s)


def name_key(c: Column) -> Column:
    """Spelling of a name without case, spaces, punctuation and underscores."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"(?U)[\W_]+", "")


def query_terms(c: Column) -> Column:
    """Distinct words in order of first occurrence; whatever a user typed is text, never syntax."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, as the index has them (marks are folded by ``folded``)."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Accented letters of Latin script and their base letters.
ACCENTED, BASE = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case with the accents of composed Latin letters removed (``ß`` stays)."""
    return F.translate(F.lower(c), ACCENTED, BASE)


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio, 2 * matches / (length of both)."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def keyword_pattern(keyword: Column) -> Column:
    """Regular expression of one keyword: word boundaries only where its edge is a word sign, up to
    three letters of ending behind a phrase of several words that ends in a letter."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(keyword, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    head = F.when(keyword.rlike(r"(?U)^\w"), r"(?<!\w)").otherwise("")
    several, letter = keyword.rlike(r"\s"), keyword.rlike(r"\p{L}$")
    tail = F.when(several & letter, r"\p{L}{0,3}(?!\w)").when(keyword.rlike(r"(?U)\w$"), r"(?!\w)").otherwise("")
    return F.concat(F.lit("(?iuU)"), head, quoted, tail)


def keyword_hits(text: Column, keywords: Column) -> Column:
    """The keywords that occur in the text, in their order; blank keywords never do."""
    return F.filter(keywords, lambda k: k.isNotNull() & (F.trim(k) != "") & F.call_function("rlike", text, keyword_pattern(F.trim(k))))


def without_reasoning(reply: Column) -> Column:
    """A reply without its reasoning block, closed or not."""
    return F.regexp_replace(reply, r"(?s)<think>.*?(?:</think>|\z)", " ")


def last_verdict(reply: Column) -> Column:
    """The last ``URTEIL:`` line of a judge's reply without its reasoning block; ``unparsebar`` if it names no verdict."""
    found = F.lower(F.try_element_at(F.regexp_extract_all(without_reasoning(reply), F.lit(r"(?i)URTEIL\s*[:=]\s*[*_`\"'\s]*([A-Za-zÄÖÜäöüß]+)"), F.lit(1)), F.lit(-1)))
    return F.when(found.isin(*VERDICTS), found).otherwise("unparsebar")


def normal_label(label: Column) -> Column:
    """A verdict in one spelling; what is none of the four is ``unparsebar``."""
    s = F.regexp_replace(F.lower(label), r"(?U)^\s+|[\s.!]+$", "")
    return F.when(s.isin(*VERDICTS), s).otherwise("unparsebar")


#: Words that deny the class named one or two words later.
NEGATIONS = ("kein", "keine", "keinen", "keinem", "keiner", "keins", "nicht", "weder", "noch", "statt", "anstatt", "ohne")


def class_of_reply(reply: Column) -> Column:
    """The one class that a classifier's reply names: as a bare word, in its last line, or anywhere; ``regel`` otherwise.

    A class counts where it stands as a word of its own, no other class is named even inside a longer
    word, and no negation is among the two words before it.
    """
    clean = F.trim(F.lower(reply))
    rest = F.trim(without_reasoning(clean))
    lines = F.filter(F.transform(F.split(rest, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def named(text: Column) -> Column:
        w = F.regexp_extract_all(text, F.lit(r"[a-zäöüß]+"), F.lit(0))
        at = F.transform(w, lambda x, i: F.struct(x.alias("x"), F.slice(w, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))).alias("b")))
        free = F.transform(F.filter(at, lambda s: ~F.arrays_overlap(s["b"], F.array(*map(F.lit, NEGATIONS)))), lambda s: s["x"])
        within = lambda c: F.exists(free, lambda x: F.contains(x, F.lit(c)))
        inside = F.array_compact(F.array(*[F.when(within(c), c) for c in CLASSES]))
        alone = F.array_compact(F.array(*[F.when(F.array_contains(free, c), c) for c in CLASSES]))
        return F.when((F.size(alone) == 1) & (F.size(inside) == 1), F.get(alone, F.lit(0)))

    last = F.try_element_at(lines, F.lit(-1))
    return F.when(reply.isNotNull(), F.coalesce(F.when(clean.isin(*CLASSES), clean), F.when(last.isin(*CLASSES), last), named(last), named(rest), F.lit("regel")))


#: Conjunctions before which the dash of a shortened word stays.
CONJUNCTIONS = {"de": ("und", "oder", "bis", "sowie", "bzw"), "en": ("and", "or", "to", "nor")}


def dehyphenated(lines: Column, language: str = "de", conjunctions: tuple[str, ...] | None = None) -> Column:
    """(text, verbunden, behalten): lines joined to running text, with the numbers of joined and kept dashes.

    A soft hyphen or a dash before a small letter joins the word, a dash before a conjunction, behind a
    digit or before a capital stays, a slash joins without a space.
    """
    joiners = CONJUNCTIONS.get(language, ()) if conjunctions is None else conjunctions
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("verbunden"), F.lit(0).alias("behalten"))

    def step(acc: Column, raw: Column) -> Column:
        spaced = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
        line = F.concat(F.replace(F.regexp_replace(spaced, "\u00ad$", ""), F.lit("\u00ad"), F.lit("")), F.when(F.endswith(spaced, F.lit("\u00ad")), "\u00ad").otherwise(""))
        left = acc["text"]
        word = F.lower(F.regexp_extract(line, r"(?U)^(\w+)", 1))
        dash = left.rlike(r"[\p{L}\p{N}]-$") & line.rlike(r"^\p{L}")
        cut = F.substring(left, F.lit(1), F.length(left) - 1)
        soft = F.endswith(left, F.lit("\u00ad"))
        conj = dash & (word.isin(*joiners) if joiners else F.lit(False))
        kept = dash & (left.rlike(r"\p{N}-$") | line.rlike(r"^\p{Lu}"))
        text = (
            F.when(line == "", left).when(left == "", line).when(soft, F.concat(cut, line)).when(conj, F.concat(left, F.lit(" "), line)).when(kept, F.concat(left, line))
            .when(dash, F.concat(cut, line)).when(F.endswith(left, F.lit("/")), F.concat(left, line)).otherwise(F.concat(left, F.lit(" "), line))
        )
        both = (line != "") & (left != "")
        joined = both & (soft | (dash & ~conj & ~kept))
        stays = both & ~soft & (conj | kept)
        return F.struct(text.alias("text"), (acc["verbunden"] + F.when(joined, 1).otherwise(0)).alias("verbunden"), (acc["behalten"] + F.when(stays, 1).otherwise(0)).alias("behalten"))

    end = lambda a: F.struct(F.regexp_replace(a["text"], "\u00ad$", "").alias("text"), a["verbunden"].alias("verbunden"), a["behalten"].alias("behalten"))
    return F.aggregate(F.filter(lines, lambda x: x.isNotNull()), zero, step, end)


def without_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("\u00ad"), F.lit(""))


def composed(c: Column) -> Column:
    """Text in composed form (NFC)."""

    @pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    # text of ASCII and composed Latin letters is composed already and needs no Python
    return F.when(c.rlike(r"^[\x00-\u02ff]*\z"), c).otherwise(nfc(c))


def chat_key(c: Column) -> Column:
    """``name_key`` with umlauts spelled out and other marks removed."""
    k = name_key(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        k = F.replace(k, F.lit(a), F.lit(b))
    return without_marks(k)


def title_norm(c: Column) -> Column:
    """Composed form, runs of whitespace as one space."""
    return single_spaced(composed(c))


def line_key(c: Column) -> Column:
    """Composed form without whitespace and format signs, without case."""
    return F.replace(F.lower(F.regexp_replace(composed(c), r"(?U)[\s\p{Cf}]+", "")), F.lit("ß"), F.lit("ss"))


def judge_norm(c: Column) -> Column:
    """Small letters, umlauts spelled out, runs of whitespace as one space."""
    s = F.lower(single_spaced(c))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def deletions(line: Column, title: Column) -> Column:
    """Number of letters of the title that the line leaves out, if it is the title but for so few; else null.

    Up to a tenth of the title's letters and at least one may be missing, none of a title under six.
    Both are compared by ``line_key``.
    """
    z, t = line_key(line), line_key(title)
    # the letters of the line are looked for one after the other: what is left of the title, or null
    rest = F.aggregate(F.split(z, ""), t, _after)
    missing = F.length(t) - F.length(z)
    most = F.when(F.length(t) < 6, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / 10).cast("int")))
    return F.when((F.length(t) > 0) & (missing >= 0) & (missing <= most) & rest.isNotNull(), missing)


def _after(text: Column, sign: Column) -> Column:
    """What follows the first ``sign`` in the text; null where it is missing."""
    at = F.call_function("instr", text, sign)
    return F.when(sign == "", text).when(at > 0, F.call_function("substring", text, at + 1))


def font_style(name: Column) -> Column:
    """(fett, kursiv, kapitaelchen) by the font's name behind its subset mark."""
    bare = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^+]*)$", 1)
    return F.struct(bare.rlike(r"Bold|Semibold|SemiBold|Demi|Heavy|Black").alias("fett"), bare.rlike(r"Italic|Oblique|Kursiv").alias("kursiv"), bare.rlike(r"SC(?![a-z])|SmallCaps|Smallcaps").alias("kapitaelchen"))


def without_footer(text: Column) -> Column:
    """An earlier answer without the lines of sources, errors and hints that were put behind it."""
    for pattern in (r"(?:\n\n)?---\n\*Quelle: [^\n]*\*\s*\z", r"(?:\n\n)?---\n\*Abgerufen: [^\n]*\*\s*\z", r"(?s)(?:\n\n)?\*\*Fehler in der RAG-Pipe:\*\*.*\z", r"(?:\n\n)?Hinweis: nur teilweise belegt[^\n]*\s*\z"):
        text = F.regexp_replace(text, pattern, "")
    return text


def flat_message(parts: Column) -> Column:
    """Text of a message in parts: those of type ``text``, joined by a space."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def without_politeness(text: Column) -> Column:
    """Words without ``bitte`` and ``danke`` at the end; one word always stays."""
    w = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != "")
    polite = F.transform(w, lambda x: name_key(x).isin("bitte", "danke"))
    # the last word that is not polite
    last = F.array_max(F.transform(polite, lambda p, i: F.when(~p, i + 1).otherwise(1)))
    return F.array_join(F.slice(w, F.lit(1), F.coalesce(last, F.lit(0))), " ")


def named_values(text: Column) -> Column:
    """Lines of the form ``name: value`` without their list marks; shorter ones than six characters are none."""
    bare = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^[\s\-*0-9.]+", ""), r"(?U)\s+$", ""))
    return F.filter(bare, lambda x: F.contains(x, F.lit(":")) & (F.length(x) > 5))


def page_of_name(file: Column, given: Column) -> Column:
    """Page of an image by its name (``seite_12.png``); a page given counts before it. Null where none is, or it is under 1."""
    p = F.coalesce(given, F.try_to_number(F.nullif(F.regexp_extract(file, r"(?i)seite_?(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("int"))
    return F.when(p >= 1, p)


def numbered(items: Column) -> Column:
    """An enumeration, one line per entry."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def history_prompt(earlier: Column) -> Column:
    """The part of a judge's prompt that names the user's earlier questions; empty without any."""
    head = "Bisheriger Gesprächsverlauf (Fragen des Nutzers, älteste zuerst):\n"
    return F.when(F.coalesce(F.size(earlier), F.lit(0)) > 0, F.concat(F.lit(head), numbered(earlier), F.lit("\n\n"))).otherwise("")


def earlier_questions(history: Column, question: Column) -> Column:
    """The user's questions before the last one, which the history may repeat at its end."""
    n = F.size(history)
    return F.when(n <= 0, history).when(F.try_element_at(history, F.lit(-1)) == question, F.slice(history, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(history)
