"""Lines of a page layout into sections: margins, fonts, headings, page numbers, routes and suspicions.

A line is a row with ``doc_id, page, line_no, text, cls`` and, where known, ``top, bottom, x0, x1, page_h``
and ``font`` (size, fett, kursiv, kapitaelchen, laufweite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import deletions, dehyphenated, font_style, title_norm
from groundwork.operators.chunking import paragraph_blocks

#: Classes whose lines are never headings, and flags of a font's style.
VETO = ("table", "caption", "page_header", "page_footer")
STYLES = ("fett", "kursiv", "kapitaelchen")


def in_margin(top: Column, bottom: Column, page_height: Column, head: float | None = None, foot: float | None = None) -> Column:
    """Whether a line's middle is in the head or foot margin (bounds included); null for a line without a place."""
    middle = (top + bottom) / 2
    hit = F.lit(False)
    if head is not None:
        hit = hit | (middle <= head)
    if foot is not None:
        hit = hit | F.coalesce(middle >= page_height - foot, F.lit(False))
    return F.when(top.isNotNull() & bottom.isNotNull(), hit)


def heading_level(font: Column, levels: list[dict]) -> Column:
    """The smallest level (from 1) of which the font meets everything that is declared: ranges of ``groesse`` and ``laufweite``, flags of style."""
    out = []
    for n, level in enumerate(levels, 1):
        fits = F.lit(True)
        for range_ in ("groesse", "laufweite"):
            if range_ in level:
                fits = fits & F.coalesce(font[range_].between(*map(float, level[range_])), F.lit(False))
        for flag in STYLES:
            if flag in level:
                fits = fits & (F.coalesce(font[flag], F.lit(False)) == bool(level[flag]))
        out.append(F.when(font.isNotNull() & fits, n))
    return F.coalesce(*out) if out else F.lit(None).cast("int")


def layout_decision(cls: Column, text: Column, font: Column, layout: dict) -> Column:
    """Level of a heading by its layout; null for running text.

    Vetoed classes and lines over ``hoechstlaenge`` are none. The font's level decides; a line without a
    font (or where no levels are declared) of the class ``klasse`` is a heading of level 1.
    """
    levels = layout.get("stufen") or []
    veto = cls.isin(*VETO, *(layout.get("veto") or []))
    short = F.length(F.trim(text)) <= layout["hoechstlaenge"] if layout.get("hoechstlaenge") else F.lit(True)
    fallback = (font.isNull() if levels else F.lit(True)) & (cls == layout["klasse"] if layout.get("klasse") else F.lit(False))
    return F.when(~F.coalesce(veto, F.lit(False)) & short, F.coalesce(heading_level(font, levels), F.when(fallback, 1)))


def glyphs_to_lines(glyphs: DataFrame, lines: DataFrame, slack: float = 1.0, cell: float = 50.0) -> DataFrame:
    """``glyphs`` with the ``line_no`` of the smallest box (then the first line) that holds their middle, null where none does.

    The range join is an equi-join: a box goes to the grid cells it touches, a glyph to its own.
    """
    g = glyphs.withColumn("_x", (F.col("x0") + F.col("x1")) / 2).withColumn("_y", (F.col("top") + F.col("bottom")) / 2).withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell))
    box = lines.where("x0 is not null and x1 is not null and top is not null and bottom is not null")
    span = lambda a, b: F.sequence(F.floor((F.col(a) - slack) / cell), F.floor((F.col(b) + slack) / cell))
    b = box.select("doc_id", "page", "line_no", *[F.col(c).alias(f"l{c}") for c in ("x0", "x1", "top", "bottom")], F.explode(span("x0", "x1")).alias("_cx"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    b = b.withColumn("_cy", F.explode(F.sequence(F.floor((F.col("_t") - slack) / cell), F.floor((F.col("_b") + slack) / cell)))).drop("_t", "_b")
    inside = F.col("_x").between(F.col("lx0") - slack, F.col("lx1") + slack) & F.col("_y").between(F.col("ltop") - slack, F.col("lbottom") + slack)
    area = (F.col("lx1") - F.col("lx0")) * (F.col("lbottom") - F.col("ltop"))
    best = g.join(b, ["doc_id", "page", "_cx", "_cy"]).where(inside).groupBy("doc_id", "page", "glyph_no").agg(F.min(F.struct(area.alias("a"), F.col("line_no").alias("line_no"))).alias("m"))
    return glyphs.join(best.select("doc_id", "page", "glyph_no", F.col("m.line_no").alias("line_no")), ["doc_id", "page", "glyph_no"], "left")


def majority_font(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """(by, font): the font that more than half of the glyphs have, by size to a tenth and style; null without such a majority.

    ``laufweite`` is the mean gap from a glyph of that font to the next one on its base line.
    """
    d = glyphs.select(*by, "x0", "x1", F.round("bottom", 1).alias("base"), F.round("size", 1).alias("groesse"), font_style(F.col("fontname")).alias("s"))
    d = d.select(*by, "x0", "x1", "base", "groesse", *[F.col(f"s.{c}").alias(c) for c in STYLES])
    kind = ["groesse", *STYLES]
    gap = F.lead("x0").over(Window.partitionBy(*by, *kind, "base").orderBy("x0", "x1")) - F.col("x1")
    g = d.withColumn("gap", gap).groupBy(*by, *kind).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("laufweite"))
    whole = g.groupBy(*by).agg(F.sum("n").alias("alle"), F.max_by(F.struct(*kind, F.coalesce("laufweite", F.lit(0.0)).alias("laufweite")), "n").alias("font"), F.max("n").alias("most"))
    return whole.select(*by, F.when(2 * F.col("most") > F.col("alle"), F.col("font")).alias("font"))


def printed_page(physical: Column, offset: int) -> Column:
    """Printed number of a physical page; null before the first."""
    return F.when(physical - offset >= 1, physical - offset)


def physical_page(printed: Column, offset: int) -> Column:
    return printed + offset


def labelled_page(labels: Column, physical: Column) -> Column:
    """Printed number by the document's page labels; null where the label is no arabic number."""
    label = F.try_element_at(labels, physical)
    return F.when(label.rlike(r"^\d+$"), label.cast("int"))


def wrong_control_points(points: DataFrame, offset: int) -> DataFrame:
    """Control points (physical, printed) that the offset does not give; empty if all is well."""
    return points.where(~printed_page(F.col("physical"), offset).eqNullSafe(F.col("printed")))


def heading_list(contents: DataFrame, offset: int) -> DataFrame:
    """A declared table of contents (doc_id, entry_no, titel, ebene, seite printed) with physical pages."""
    return contents.select("doc_id", "entry_no", title_norm(F.col("titel")).alias("titel"), F.greatest(F.coalesce("ebene", F.lit(1)), F.lit(1)).alias("ebene"), physical_page(F.col("seite"), offset).alias("page"))


def found_headings(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, entry_no, titel, ebene, page, line_no, gefunden): the line where each heading of the list begins its section.

    On its page the line with the fewest left-out letters counts, the first of several. A heading that
    no line matches starts behind the last one of the list found before it on its page, else at the top.
    """
    # letters of line and title, looked at once a pair of one page
    pairs = headings.join(lines.select("doc_id", "page", "line_no", "text"), ["doc_id", "page"]).withColumn("d", deletions(F.col("text"), F.col("titel"))).where("d is not null")
    best = pairs.groupBy("doc_id", "entry_no").agg(F.min(F.struct("d", "line_no")).alias("m"))
    # a line belongs to one heading only, the first that claims it
    claim = best.select("doc_id", "entry_no", F.col("m.line_no").alias("line_no")).join(headings.select("doc_id", "entry_no", "page"), ["doc_id", "entry_no"])
    claim = claim.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", "line_no").orderBy("entry_no"))).where("r = 1").select("doc_id", "entry_no", "line_no")
    j = headings.join(claim, ["doc_id", "entry_no"], "left")
    w = Window.partitionBy("doc_id", "page").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("line_no", ignorenulls=True).over(w)
    first = lines.groupBy("doc_id", "page").agg(F.min("line_no").alias("_top"))
    j = j.withColumn("_before", before).join(first, ["doc_id", "page"], "left")
    start = F.coalesce("line_no", F.col("_before") + 1, "_top", F.lit(0))
    return j.select("doc_id", "entry_no", "titel", "ebene", "page", start.alias("line_no"), F.col("line_no").isNotNull().alias("gefunden"))


def heading_paths(headings: DataFrame, by: list[str], order: str, title: str, level: str) -> DataFrame:
    """(by, order, pfad): the path of each heading of a list: the first ``level - 1`` of the path before it, and its title."""
    g = headings.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)).alias("n"), F.col(title).alias("t")))).alias("_l"))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("now"), F.array().cast("array<array<string>>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = F.concat(F.slice(acc["now"], F.lit(1), x["n"] - 1), F.array(x["t"]))
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    paths = F.aggregate("_l", zero, step, lambda a: a["all"])
    return g.select(*by, F.explode(F.arrays_zip(F.col("_l").alias("l"), paths.alias("p"))).alias("z")).select(*by, F.col("z.l.o").alias(order), F.col("z.p").alias("pfad"))


def open_levels(headings: DataFrame, by: list[str], order: str, title: str, level: str, deepest: int = 9) -> DataFrame:
    """``headings`` (found by their layout) with ``pfad``: the open headings of all smaller levels and the heading itself.

    The last heading of each level is open unless one of a smaller level came after it.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = headings
    for n in range(1, deepest + 1):
        d = d.withColumn(f"_h{n}", F.max(F.when(F.col(level) == n, F.struct(F.col(order).alias("o"), F.col(title).alias("t")))).over(w))
    # open: no later heading of a smaller level
    parts = []
    for n in range(1, deepest + 1):
        smaller = F.greatest(F.lit(-1).cast("long"), *[F.coalesce(F.col(f"_h{m}.o").cast("long"), F.lit(-1).cast("long")) for m in range(1, n)]) if n > 1 else F.lit(-1).cast("long")
        parts.append(F.when((F.col(level) >= n) & (F.col(f"_h{n}.o").cast("long") > smaller), F.col(f"_h{n}.t")))
    return d.withColumn("pfad", F.array_compact(F.array(*parts))).drop(*[f"_h{n}" for n in range(1, deepest + 1)])


def sections(lines: DataFrame, headings: DataFrame, language: str = "de", preamble: str = "Vorspann") -> DataFrame:
    """(doc_id, abschnitt_nr, pfad, text, seiten): the lines of each document cut at its headings and joined to running text.

    ``headings`` has ``doc_id, page, line_no, pfad`` and ``gefunden`` (the line is the heading itself and no
    part of the text). Lines before the first heading are the section ``preamble``. Each line is labelled
    by a running count of headings; a section's lines are then gathered in order, so a section, not a
    document, is what one task holds.
    """
    marks = headings.groupBy("doc_id", "page", "line_no").agg(F.max_by("pfad", "entry_no").alias("pfad"), F.max("gefunden").alias("gefunden"))
    d = lines.join(marks, ["doc_id", "page", "line_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("abschnitt_nr", F.count("pfad").over(w))
    body = F.when(~F.coalesce("gefunden", F.lit(False)), F.col("text"))
    g = d.groupBy("doc_id", "abschnitt_nr").agg(
        F.max("pfad").alias("pfad"), F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("page", "line_no", F.col("text").alias("t"))))).alias("_l"), F.sort_array(F.collect_set("page")).alias("seiten")
    )
    text = dehyphenated(F.transform("_l", lambda x: x["t"]), language)["text"]
    path = F.coalesce("pfad", F.array(F.lit(preamble)))
    return g.select("doc_id", "abschnitt_nr", path.alias("pfad"), text.alias("text"), "seiten").where("text <> '' or abschnitt_nr > 0")


def layout_headings(lines: DataFrame, listed: DataFrame, layout: dict) -> DataFrame:
    """(doc_id, page, line_no, pfad, entry_no, gefunden) of ``listed`` headings and of those the layout shows between them.

    A heading by layout stands below the listed one before it (below nothing, without any); levels start
    anew with every listed heading. ``listed`` has the same columns.
    """
    d = lines.join(listed.select("doc_id", "page", "line_no", "pfad", "entry_no", "gefunden"), ["doc_id", "page", "line_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_s", F.count("pfad").over(w)).withColumn("_p", F.last("pfad", ignorenulls=True).over(w)).withColumn("_o", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no")))
    level = layout_decision(F.col("cls"), F.col("text"), F.col("font"), layout)
    own = d.where(F.coalesce(~F.col("gefunden"), F.lit(True))).withColumn("_n", level).where("_n is not null").withColumn("_t", title_norm(F.col("text")))
    own = open_levels(own.drop("pfad"), ["doc_id", "_s"], "_o", "_t", "_n")
    own = own.select("doc_id", "page", "line_no", F.concat(F.coalesce("_p", F.array().cast("array<string>")), F.col("pfad")).alias("pfad"), F.coalesce("entry_no", F.lit(-1)).alias("entry_no"), F.lit(True).alias("gefunden"))
    return listed.select("doc_id", "page", "line_no", "pfad", "entry_no", "gefunden").join(own.select("doc_id", "page", "line_no"), ["doc_id", "page", "line_no"], "left_anti").unionByName(own)


def suspicions(sections: DataFrame, by: list[str], text: str, page: str, conjunctions: tuple[str, ...]) -> DataFrame:
    """(by, art, anzahl, seiten): capitals inside words and dashes left behind, with the pages they stand on."""
    t = F.col(text)
    capitals = F.size(F.regexp_extract_all(t, F.lit(r"\p{Ll}(?=\p{Lu})"), F.lit(0)))
    rest = F.regexp_extract_all(t, F.lit(r"(?U)(?<=\p{L})- +(\w+)"), F.lit(1))
    left = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Ll}") & ~F.lower(w).isin(*conjunctions)))
    d = sections.select(*by, F.col(page).alias("_p"), F.explode(F.array(F.struct(F.lit("binnen_grossbuchstabe").alias("art"), capitals.alias("n")), F.struct(F.lit("strichrest").alias("art"), left.alias("n")))).alias("v")).where("v.n > 0")
    return d.groupBy(*by, F.col("v.art").alias("art")).agg(F.sum("v.n").alias("anzahl"), F.sort_array(F.collect_set("_p")).alias("seiten"))


def protocol(lines: DataFrame, sections: DataFrame, margin: Column) -> DataFrame:
    """(doc_id, zeilen, randzeilen, ohne_lage, abschnitte): one row of counts per document."""
    a = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("zeilen"), F.count_if(margin).alias("randzeilen"), F.count_if(margin.isNull()).alias("ohne_lage"))
    b = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("abschnitte"))
    return a.join(b, "doc_id", "left").na.fill(0, ["abschnitte"])


def page_blocks(items: DataFrame, by: list[str], order: str, text: str, target: int = 1200) -> DataFrame:
    """(by, block_nr, block): the paragraphs of each page packed up to ``target``, so that a block has one page."""
    g = items.where(F.col(text).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_i"))
    whole = F.array_join(F.transform("_i", lambda x: x["t"]), "\n\n")
    return g.select(*by, F.posexplode(paragraph_blocks(whole, target)).alias("block_nr", "block"))


def page_routes(items: DataFrame, by: list[str], threshold: int = 50) -> DataFrame:
    """(by, texte, tabellen, route): ``vision`` for pages of more text items than ``threshold``, else ``text/table``."""
    g = items.groupBy(*by).agg(F.count_if(F.col("cls") != "table").alias("texte"), F.count_if(F.col("cls") == "table").alias("tabellen"))
    return g.withColumn("route", F.when(F.col("texte") > threshold, "vision").otherwise("text/table"))


def layout_histogram(items: DataFrame, by: list[str], label: str) -> DataFrame:
    return items.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
