"""State of an index by content hashes: what is new, changed, current or gone, and the rows and steps that follow from it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a collection whose hashes are gathered at once.
BUCKET = 4096
#: Version of what a configuration key says.
SCHEMA = 1


def config_key(model: str, size: int, overlap: int) -> str:
    """The canonical key of an index's configuration; types left out at reading are no part of it."""
    return json.dumps({"embed": model, "overlap": overlap, "schema": SCHEMA, "size": size}, sort_keys=True)


def snapshot_tag(collection: Column, config: Column) -> Column:
    return F.sha1(F.concat(collection, F.lit("\0"), config))


def fingerprints(df: DataFrame, collection: str, id: str, text: str, config: str = "", bucket: int = BUCKET) -> DataFrame:
    """(collection, n_chunks, fingerprint): a hash over the row hashes in order of ``id``; a null text counts as empty.

    Ids fall in buckets of ``bucket`` neighbouring ids; the hashes of a bucket are hashed first and those of
    the buckets then, so no task gathers more than a bucket of rows and a collection's list of buckets.
    """
    row = F.sha2(F.concat(F.lit(config), F.col(id).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256)

    def joined(name: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("h")))), lambda x: x["h"]), ""), 256)

    b = df.select(collection, F.col(id).alias("_i"), F.floor(F.col(id) / bucket).alias("_b"), row.alias("h")).groupBy(collection, "_b").agg(F.count(F.lit(1)).alias("n"), joined("_i").alias("h"))
    return b.groupBy(collection).agg(F.sum("n").alias("n_chunks"), joined("_b").alias("fingerprint"))


def collection_fingerprints(books: DataFrame, collection: str, order: str, config: str) -> DataFrame:
    """(collection, n_chunks, fingerprint) of collections of several books: configuration, declaration and the books' hashes in their order.

    ``books`` has ``buch_id, deklaration, fingerprint, n_chunks``; a collection has few books.
    """
    one = F.concat_ws("\0", "buch_id", F.coalesce("deklaration", F.lit("")), "fingerprint")
    g = books.groupBy(collection).agg(F.sum("n_chunks").alias("n_chunks"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("h")))).alias("_l"))
    return g.select(collection, "n_chunks", F.sha2(F.concat(F.lit(config + "\0"), F.array_join(F.transform("_l", lambda x: x["h"]), "\0")), 256).alias("fingerprint"))


def status(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, status) with ``neu``, ``geaendert``, ``aktuell`` or ``entfernt``."""
    j = now.select(key, F.col("fingerprint").alias("n")).join(stored.select(key, F.col("fingerprint").alias("o")), key, "full")
    s = F.when(F.col("o").isNull(), "neu").when(F.col("n").isNull(), "entfernt").when(F.col("n") == F.col("o"), "aktuell").otherwise("geaendert")
    return j.select(key, s.alias("status"))


def book_plan(now: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """(by, schritt) for every book: ``einbetten`` where its content is new, ``umschreiben`` where only its declaration is, ``behalten`` or ``loeschen``.

    Both sides have ``fingerprint`` and ``deklaration``.
    """
    n = now.select(*by, F.col("fingerprint").alias("nf"), F.col("deklaration").alias("nd"))
    o = stored.select(*by, F.col("fingerprint").alias("of"), F.col("deklaration").alias("od"))
    s = F.when(F.col("nf").isNull(), "loeschen").when(F.col("of").isNull() | (F.col("nf") != F.col("of")), "einbetten").when(~F.col("nd").eqNullSafe(F.col("od")), "umschreiben").otherwise("behalten")
    return n.join(o, by, "full").select(*by, s.alias("schritt"))


def refreshed(stored: DataFrame, declared: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """The chunks of the next snapshot: kept books as stored, the others as declared, gone ones left out.

    ``declared`` and ``stored`` have the same columns. Only the rows of books to embed come from ``declared``
    with a new vector; where a book is merely declared anew its rows keep the stored ``emb``.
    """
    keep = stored.join(plan.where("schritt = 'behalten'").select(*by), by, "left_semi")
    fresh = declared.join(plan.where("schritt = 'einbetten'").select(*by), by, "left_semi")
    again = declared.drop("emb").join(plan.where("schritt = 'umschreiben'").select(*by), by, "left_semi").join(stored.select(*by, "pos", "emb"), [*by, "pos"], "left")
    return keep.unionByName(fresh).unionByName(again)


def renumbered(chunks: DataFrame, collection: str, order: list[str]) -> DataFrame:
    """``chunks`` with ``pos`` counting 0, 1, 2 ... within the collection, in ``order``."""
    return chunks.withColumn("pos", (F.row_number().over(Window.partitionBy(collection).orderBy(*order)) - 1).cast("int"))


def removed(stored: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Keys of stored collections that no one declares any more."""
    return stored.select(key).distinct().join(declared.select(key), key, "left_anti")


def without_collections(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of collections that are gone."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def replaced(old: DataFrame, new: DataFrame, source: str, id: str) -> DataFrame:
    """``old`` without the rows of the sources that ``new`` has, and ``new`` with the next free ids.

    New rows are numbered in the order of their own ``id`` behind the largest id that stays, so doing it
    twice changes nothing but ids that the first time gave.
    """
    keep = old.join(new.select(source).distinct(), source, "left_anti")
    top = keep.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))  # one row
    # sources are numbered for themselves and set off by the sizes of those before; that window has one row a source
    n = new.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(id)))
    before = n.groupBy(source).agg(F.count(F.lit(1)).alias("_c"))
    before = before.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = n.join(before, source).join(F.broadcast(top)).withColumn(id, (F.col("_top") + F.col("_before") + F.col("_n")).cast(old.schema[id].dataType))
    return keep.unionByName(numbered.select(*old.columns))


def stale(loaded: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Collections whose loaded state is not that of their files any more."""
    return status(now, loaded, key).where("status <> 'aktuell'")


def migrated(rows: DataFrame, collection: str, name: str) -> DataFrame:
    """Rows of a single file as those of one collection, content and order as they were."""
    return rows.withColumn("spiel_id", F.lit(collection)).withColumn("spiel", F.lit(name))


def with_missing_columns(df: DataFrame, schema) -> DataFrame:
    """``df`` of an older layout with the columns it lacks as null, in the order of ``schema``."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def same_dimension(chunks: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Groups whose vectors have different lengths; empty if all is well."""
    g = chunks.where(F.col(vector).isNotNull()).groupBy(*by).agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"))
    return g.where("least <> most")
