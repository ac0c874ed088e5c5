"""Texts over a limit cut into overlapping pieces under it, at natural boundaries where there are any.

One bounded regular expression consumes a text from left to right: at every place the alternatives
are tried by strength (rest of the text, blank line, sentence end, whitespace, any character), each
greedily up to the limit less the overlap. What precedes a body supplies the overlap. All of it is
SQL array functions inside the scan's stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import table

LIMIT, OVERLAP = 1200, 150
#: What ends a paragraph and a sentence, and whitespace, in Java's and in RE2's form.
BLANK_LINE = r"\n[^\S\n]*\n"
STOP, WIDE_STOP = ".!?", "。！？"
#: Kinds of boundaries, the strongest first.
GRENZEN = ("absatz", "satz", "wort", "hart")


def _bodies(text: Column, most: int) -> Column:
    n = most
    pattern = (
        rf"(?U)\s*+(?:[\s\S]{{1,{n}}}(?=\s*\z)|[\s\S]{{1,{n}}}(?=\s*{BLANK_LINE})|[\s\S]{{0,{n - 1}}}(?:[{STOP}](?=\s)|[{WIDE_STOP}])"
        rf"|[\s\S]{{1,{n}}}(?=\s)|[\s\S]{{1,{n}}})"
    )
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def boundary_kind(bodies: Column) -> Column:
    """The weakest kind of boundary that the text was cut at.

    At every place the strongest boundary in reach is taken, and all stretches begin at a cut or
    behind one, so a kind is used just where a stretch between stronger boundaries exceeds the limit.
    """

    def cut(body: Column, i: Column) -> Column:
        after = F.get(bodies, i + 1)  # begins with the whitespace behind the cut
        return (
            F.when(after.isNull() | after.rlike(rf"(?U)^\s*?{BLANK_LINE}") | (F.trim(after) == ""), 0)
            .when(body.rlike(rf"[{WIDE_STOP}]\z") | (body.rlike(rf"[{STOP}]\z") & after.rlike(r"(?U)^\s")), 1)
            .when(after.rlike(r"(?U)^\s"), 2)
            .otherwise(3)
        )

    return F.element_at(F.array(*[F.lit(x) for x in GRENZEN]), F.coalesce(F.array_max(F.transform(bodies, cut)), F.lit(0)) + 1)


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``df`` whose text has more than ``limit`` characters, with ``grenze`` and ``stuecke``.

    ``stuecke`` is an array of ``nr`` (from 0), ``von`` and ``bis`` (the new characters of the piece,
    code points of the text) and ``stueck``, never longer than ``limit``, which starts with up to
    ``overlap`` characters from before ``von``, from a word's start where one is near. Bodies together
    hold all of the text but whitespace at cuts and ends. Null, empty and shorter texts give no row;
    blank text over the limit gives no piece. Columns named like the new ones are an error.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if clash := {"grenze", "stuecke", "_koerper", "_enden", "_reste"} & set(df.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    t = F.col(text)
    long = df.where(F.length(t) > limit)
    long = long.withColumn("_koerper", _bodies(t, limit - overlap)).withColumn("grenze", boundary_kind(F.col("_koerper")))
    ends = F.aggregate("_koerper", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(b))))
    # what precedes a body is looked for in the last characters of those before it
    long = long.withColumn("_enden", ends).withColumn("_reste", F.transform("_koerper", lambda b: F.right(b, F.lit(overlap + 1))))

    def before(i: Column, most: int) -> Column:
        return F.array_join(F.slice("_reste", F.greatest(i - most + 1, F.lit(1)), F.least(i, F.lit(most))), "")

    def piece(body: Column, i: Column) -> Column:
        bare = F.regexp_replace(body, r"(?U)^\s+", "")
        lead = F.length(body) - F.length(bare)
        room = F.greatest(F.lit(overlap) - lead, F.lit(0))
        # a few bodies back there is nearly always enough; every body has a character, so ``overlap`` bodies are
        few = before(i, 3)
        ahead = F.when(i == 0, "").when((i <= 3) | (F.length(few) > overlap), few).otherwise(before(i, overlap + 1))
        back = F.when(room > 0, F.right(ahead, room)).otherwise("")
        cut = F.length(ahead) > room
        back = F.when(cut, F.regexp_replace(back, r"(?U)^\S{1,40}\s+(?=\S)", "")).otherwise(back)
        whole = F.when(lead <= overlap, F.concat(back, body)).otherwise(bare)
        return F.struct(
            i.alias("nr"), (F.get("_enden", i) + lead).alias("von"), F.get("_enden", i + 1).alias("bis"), _trim(whole).alias("stueck")
        )

    return long.withColumn("stuecke", F.transform("_koerper", piece)).drop("_koerper", "_enden", "_reste")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks").select("id", "text")).select("id", "grenze")


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    d = split_oversized(table(spark, sf_dir, "chunks").select("id", "spiel_id", "pos", "text"))
    return d.select("id", "spiel_id", "pos", F.explode("stuecke").alias("s")).select("id", "spiel_id", "pos", "s.nr", "s.von", "s.bis", "s.stueck")


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = rf"'^{_WS}+|{_WS}+$', '', 'g'"
P4_SQL = rf"""
with c as (select id, text from chunks where length(text) > 1200),
a as (select id, text, string_split_regex(text, '\n[ \t\r\f\v]*\n') p,
  string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n[ \t\r\f\v]*\n', chr(1), 'g'), '([.!?]){_WS}+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)) s,
  string_split(regexp_replace(regexp_replace(text, '{_WS}+', chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)) w from c),
l as (select id, list_max(list_transform(p, lambda x: length(regexp_replace(x, {_TRIM})))) p, list_max(list_transform(s, lambda x: length(regexp_replace(x, {_TRIM})))) s,
  list_max(list_transform(w, lambda x: length(x))) w from a)
select id, case when p <= 1050 then 'absatz' when s <= 1050 then 'satz' when w <= 1050 then 'wort' else 'hart' end as grenze from l
"""

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {"p4_found": P4_SQL}
