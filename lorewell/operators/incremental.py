"""Incremental maintenance: classify, merge, collapse, remove after confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import first_text, text_or_empty


def classify(state: DataFrame, seen: DataFrame, key: str = "url", hash_col: str = "content_hash") -> DataFrame:
    """key and change: new, unchanged, modified, or missing from this run; a row without a hash is there, but equals none."""
    there = F.lit(True)
    a, b = state.select(key, F.col(hash_col).alias("old"), there.alias("was")), seen.select(key, F.col(hash_col).alias("new"), there.alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return b.join(a, key, "full").select(key, change.alias("change"))


def merge(base: DataFrame, delta: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Upsert, then delete: an id in both delta and removed is gone."""
    kept = base.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.select(*base.columns)).join(removed.select(key), key, "left_anti")


def richness(names: list[str]) -> Column:
    """Sortable struct: author, date, section, tags, HTML before PDF, length, age of the copy."""

    def has(*cs: str) -> Column:
        own = [c for c in cs if c in names]
        return (F.trim(first_text(*own)) != "").cast("int") if own else F.lit(0)

    tags = F.greatest(F.size("tags"), F.lit(0)) if "tags" in names else F.lit(0)
    pdf = (text_or_empty("source_type") == "pdf") if "source_type" in names else F.lit(False)
    if "pdf_url" in names:
        pdf = pdf | (text_or_empty("pdf_url") != "")
    seen = first_text(*[c for c in ("scraped_at", "updated_at") if c in names]) if {"scraped_at", "updated_at"} & set(names) else F.lit("")
    return F.struct(has("author").alias("a"), has("date").alias("b"), has("section", "category").alias("c"), tags.alias("d"), (~pdf).cast("int").alias("e"), F.length(text_or_empty("text")).alias("f"), seen.alias("g"))


def collapse(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The richest copy of each key; of equal ones the first by `order`.  An argmax that combines map-side."""
    names = docs.columns
    rank = F.struct(richness(names).alias("r"), F.negative(order).alias("o"))
    return docs.groupBy(key.alias("__k")).agg(F.max_by(F.struct(*names), rank).alias("d")).select("d.*")


def hash_delta(old: DataFrame, new: DataFrame, col: str = "chunk_hash") -> DataFrame:
    """One row: added, removed, kept distinct hashes."""
    a, b = old.select(col).distinct().withColumn("o", F.lit(1)), new.select(col).distinct().withColumn("n", F.lit(1))
    m = a.join(b, col, "full")
    return m.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"))


def misses(runs: DataFrame, key: str, run: str, seen: str, needed: int = 2) -> DataFrame:
    """key, run, missing_count (consecutive runs without it) and confirmed."""
    w = Window.partitionBy(key).orderBy(run)
    spell = runs.withColumn("__s", F.sum(F.col(seen).cast("int")).over(w))
    count = F.sum((~F.col(seen)).cast("int")).over(Window.partitionBy(key, "__s").orderBy(run))
    return spell.select(key, run, count.cast("int").alias("missing_count"), (count >= needed).alias("confirmed"))


def removals(missing: DataFrame, recheck: DataFrame, complete: bool, failed: int, attempted: int, key: str = "url", max_failed: float = 0.2) -> DataFrame:
    """Outcome of confirmed absences: removed only in a complete, healthy run and after a 404 or 410."""
    if not complete or failed / max(1, attempted) > max_failed:
        return missing.select(key, F.lit("skipped").alias("outcome"))
    out = F.when(~F.col("confirmed"), "pending").when(F.col("status").isin(404, 410), "removed").when(F.col("status") == 200, "unlinked_but_live").otherwise("deferred")
    return missing.join(recheck.select(key, "status"), key, "left").select(key, out.alias("outcome"))


def redirected(state: DataFrame) -> DataFrame:
    """Documents whose URL now redirects to a live URL of another document."""
    a, b = state.alias("a"), state.alias("b")
    ok = F.col("b.seen") & F.col("a.document_id").isNotNull() & (F.col("a.document_id") != F.col("b.document_id"))
    return a.join(b, F.col("a.redirected_to") == F.col("b.url")).where(ok).select(F.col("a.url").alias("url"), F.col("a.document_id").alias("document_id"))


def unavailable(state: DataFrame, now: Column) -> DataFrame:
    """A failing URL keeps its document; the first failure's time stays."""
    since = F.when(F.col("failing"), F.coalesce("unavailable_since", now))
    return state.withColumn("unavailable_since", since)


def reconcile(legacy: DataFrame, current: DataFrame, url: str = "url") -> DataFrame:
    """legacy URLs with the reason why they are gone or kept."""
    now = current.select(url, F.lit(True).alias("__in"))
    why = F.when(F.col("__in"), "kept").when(F.col("redirected_to").isNotNull(), F.concat(F.lit("redirected → "), "redirected_to")).when(F.col("status").isin(404, 410), "removed").otherwise("not crawled")
    return legacy.join(now, url, "left").select(url, why.alias("reason"))


def pdf_parents(pdfs: DataFrame, links: DataFrame) -> DataFrame:
    """Each PDF with its parent page: one with a title if there is one, then the least URL."""
    best = F.max_by(F.struct("parent_url", "parent_title"), F.struct((text_or_empty("parent_title") != "").cast("int").alias("t"), F.negative(F.xxhash64("parent_url")).alias("u")))
    return pdfs.join(links.groupBy("pdf_url").agg(best.alias("p")), "pdf_url", "left").select("pdf_url", "p.parent_url", "p.parent_title")


def reasons(reconciled: DataFrame) -> DataFrame:
    """reason (without its target) and n."""
    return reconciled.groupBy(F.trim(F.split_part("reason", F.lit(" →"), F.lit(1))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def to_delete(removed: DataFrame, replaced: DataFrame) -> DataFrame:
    """Ids that a merge deletes: removed ones and those that a redirect replaced, once each."""
    return removed.unionByName(replaced).distinct()


def lost(before: DataFrame, now: DataFrame, named: dict[str, str]) -> DataFrame:
    """kind and value: values of the named columns (kind -> column) that were there and are not now."""
    out = None
    for kind, column in named.items():
        was, still = before.select(F.col(column).cast("string").alias("value")).distinct(), now.select(F.col(column).cast("string").alias("value")).distinct()
        got = was.join(still, "value", "left_anti").select(F.lit(kind).alias("kind"), "value")
        out = got if out is None else out.unionByName(got)
    return out
