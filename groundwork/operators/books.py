"""Collections of several books: editions, kinds of content, declarations, citations, section chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.chunking import spanned_pages, windows, with_path

#: Form of the keys of collections and books.
KEY = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def with_edition_rule(chunks: DataFrame, rules: DataFrame, collection: str, kind: str, edition: str) -> DataFrame:
    """``chunks`` without those of excluded editions, and with ``hinweis``.

    ``rules`` has one row per collection and kind: ``authoritative`` (array) and ``annotated`` (map of
    edition to hint). Where a kind has a rule, an edition that is neither is excluded before any
    ranking; an annotated one carries its hint. Kinds without a rule, and null kinds, pass.
    """
    r = rules.select(F.col(collection).alias("_c"), F.col(kind).alias("_k"), "authoritative", "annotated")
    j = chunks.join(r, (F.col(collection) == F.col("_c")) & (F.col(kind) == F.col("_k")), "left")
    e = F.col(edition)
    first = F.coalesce(F.array_contains("authoritative", e), F.lit(False))
    hint = F.when(~first, F.try_element_at("annotated", e))
    return j.withColumn("hinweis", hint).where(F.col("_c").isNull() | first | F.col("hinweis").isNotNull()).drop("_c", "_k", "authoritative", "annotated")


def kind_by_prefix(chunks: DataFrame, rules: DataFrame, id: str, by: list[str], path: str, default: Column) -> DataFrame:
    """(id, kind): of the rules (``by``, rule_no, prefix, kind) whose prefix begins the path the longest one, of equal ones the first declared; else ``default``."""
    r = rules.select(*by, "rule_no", "prefix", F.col("kind").alias("_kind"))
    p = F.col(path)
    fits = (F.size("prefix") <= F.size(p)) & (F.slice(p, F.lit(1), F.greatest(F.size("prefix"), F.lit(0))) == F.col("prefix"))
    rank = F.struct(F.size("prefix").alias("n"), (-F.col("rule_no")).alias("r"))
    best = chunks.join(r, by).where(fits).groupBy(id).agg(F.max_by("_kind", rank).alias("_kind"))
    return chunks.join(best, id, "left").select(id, F.coalesce("_kind", default).alias("kind"))


def with_titles(chunks: DataFrame, books: DataFrame, by: list[str], book: str) -> DataFrame:
    """``chunks`` with the ``titel`` of their book; the book's key where it has none or is not declared."""
    b = books.select(*by, F.col(book), F.col("titel").alias("_t"))
    return chunks.join(b, [*by, book], "left").withColumn("titel", F.coalesce("_t", book)).drop("_t")


def books_of(collections: DataFrame, collection: str, books: str) -> DataFrame:
    """One row per declared book with its place ``buch_nr``; a collection without books has one, ``regelwerk``."""
    d = collections.select(collection, F.posexplode_outer(books).alias("buch_nr", "_b"))
    return d.select(collection, F.coalesce("buch_nr", F.lit(0)).alias("buch_nr"), F.coalesce("_b.buch_id", F.lit("regelwerk")).alias("buch_id"), F.col("_b.fassung").alias("fassung"))


def is_multi_book(books: Column) -> Column:
    return books.isNotNull()


def declaration_errors(books: DataFrame, collection: str) -> DataFrame:
    """(collection, buch_id, fehler) of the declared books: bad keys, books twice, no edition. Empty if all is well."""
    by = Window.partitionBy(collection, "buch_id")
    c = books.select(collection, "buch_id", "fassung", F.count(F.lit(1)).over(by).alias("_n"))
    faults = F.array(
        F.when(F.col("buch_id").isNull() | ~F.col("buch_id").rlike(KEY), "schluessel"), F.when(F.col("_n") > 1, "doppelt"), F.when(F.coalesce(F.trim("fassung"), F.lit("")) == "", "fassung")
    )
    return c.select(collection, "buch_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fehler")).distinct()


def citation(title: Column, edition: Column, page: Column, page_phys: Column, hint: Column, spoken: bool = False) -> Column:
    """``Title (edition), S. n``, with the physical page where there is no printed one, and the hint of an annotated edition."""
    at = F.when(page.isNotNull(), F.concat(F.lit("Seite " if spoken else "S. "), page.cast("string")))
    at = F.coalesce(at, F.concat(F.lit("PDF-Seite " if spoken else "PDF-S. "), F.coalesce(page_phys.cast("string"), F.lit("?"))))
    text = F.concat(title, F.lit(" ("), F.coalesce(edition, F.lit("?")), F.lit("), "), at)
    return F.when(F.coalesce(hint, F.lit("")) != "", F.concat(text, F.lit(" ("), hint, F.lit(")"))).otherwise(text)


def page_list(pages: Column, spoken: bool = False) -> Column:
    """``S. 3, S. 9`` or, to be read out, ``Seite 3 und Seite 9``; empty for no page."""
    named = F.transform(pages, lambda p: F.concat(F.lit("Seite " if spoken else "S. "), p.cast("string")))
    if not spoken:
        return F.array_join(named, ", ")
    most = F.array_join(F.slice(named, F.lit(1), F.greatest(F.size(named) - 1, F.lit(0))), ", ")
    return F.when(F.size(named) <= 1, F.array_join(named, "")).otherwise(F.concat(most, F.lit(" und "), F.try_element_at(named, F.lit(-1))))


def section_chunks(sections: DataFrame, by: list[str], order: str, size: int, overlap: int) -> DataFrame:
    """(by, pos, stueck_nr, start, text, seite, seiten): sections cut in windows that never cross them.

    ``sections`` has ``pfad`` (headings), ``text`` and ``umbrueche``, an array of (offset, page) in rising
    order. The path stands before every piece and does not count; ``seiten`` are the printed pages that a
    piece runs over, ``seite`` the first. ``pos`` counts the pieces of ``by`` in ``order``, from 0.
    """
    d = sections.withColumn("_w", windows(F.col("text"), size, overlap))
    d = d.select(*by, F.col(order).alias("_o"), "pfad", "umbrueche", F.posexplode("_w").alias("stueck_nr", "_p"))
    start = F.col("_p.start")
    pages = spanned_pages(start, start + F.length("_p.piece"), F.col("umbrueche"))
    d = d.select(*by, "_o", "stueck_nr", start.alias("start"), with_path(F.col("pfad"), F.col("_p.piece")).alias("text"), F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p.isNotNull()).alias("seiten"))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("_o", "stueck_nr")) - 1
    return d.select(*by, pos.alias("pos"), "stueck_nr", "start", "text", F.get("seiten", F.lit(0)).alias("seite"), "seiten")
