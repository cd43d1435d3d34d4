"""Keeping an index in step with its sources: the three-state diff and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state: added, unchanged, touched (same content at another time), updated or removed.

    files: path, mtime, size, hash; manifest: the same. Contents' hashes only count where time or size differ.
    """
    m = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"), F.col("hash").alias("m_hash"), F.lit(True).alias("known"))
    both = files.withColumn("there", F.lit(True)).join(m, "path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("m_mtime")) & F.col("size").eqNullSafe(F.col("m_size"))
    state = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "removed").when(same, "unchanged").when(F.col("hash").eqNullSafe(F.col("m_hash")), "touched").otherwise("updated")
    return both.select("path", state.alias("state"))


def next_manifest(files: DataFrame, manifest: DataFrame, changes: DataFrame, failed: DataFrame) -> DataFrame:
    """The manifest after a sync: failed (path) additions stay out, failed updates keep the old entry."""
    bad = failed.select("path", F.lit(True).alias("bad"))
    rows = changes.join(bad, "path", "left").where("state <> 'removed'").withColumn("old", F.coalesce("bad", F.lit(False)))
    fresh = rows.where("not old").select("path").join(files, "path")
    stale = rows.where("old and state <> 'added'").select("path").join(manifest, "path")
    return fresh.unionByName(stale)


def outcomes(changes: DataFrame, failed: DataFrame, stored: DataFrame) -> DataFrame:
    """changes with outcome: added, updated, removed, unchanged (touched files too) or skipped. An addition is skipped
    where its path is stored already or has failed, an update where it has failed. failed, stored: path."""
    marked = changes.join(failed.select("path", F.lit(True).alias("bad")).distinct(), "path", "left").join(stored.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    skipped = (F.col("state").isin("added", "updated") & F.col("bad").isNotNull()) | ((F.col("state") == "added") & F.col("there").isNotNull())
    return marked.select("path", "state", F.when(skipped, "skipped").when(F.col("state") == "touched", "unchanged").otherwise(F.col("state")).alias("outcome"))


def outcome_stats(done: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged, skipped."""
    return done.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "removed", "unchanged", "skipped")])


def next_chunks(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks (path, ...) after a sync with the outcomes `done`: updated and removed files lose their old chunks, added and
    updated ones have new ones; what was skipped keeps what it has."""
    gone = done.where("outcome in ('updated', 'removed')").select("path")
    wanted = done.where("outcome in ('added', 'updated')").select("path")
    return old.join(gone, "path", "left_anti").unionByName(new.join(wanted, "path", "left_semi"))


def stats(changes: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged (touched ones too)."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return changes.agg(n("added").alias("added"), n("updated").alias("updated"), n("removed").alias("removed"), n("unchanged", "touched").alias("unchanged"))


def readable_manifest(manifest: DataFrame, version: int) -> DataFrame:
    """The manifest's entries if it is of this version, else none."""
    return manifest.where(F.col("version") == version).drop("version")


def insert_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored and those of new whose key it lacks."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and those of stored whose key it lacks."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def import_snapshot(stored: dict[str, DataFrame], snapshot: dict[str, DataFrame], keys: dict[str, str], mode: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after an import of the snapshot's, and (name, n): how many rows it brought of each.

    Mode `merge` keeps stored rows whose key the snapshot lacks, `replace` keeps none; another mode is an error. The
    table `manifest` is taken over by `replace` or where none is stored; `conversations` are always merged.
    """
    if mode not in ("merge", "replace"):
        raise ValueError(f"mode is merge or replace, not {mode!r}")
    after = dict(stored)
    for name, rows in snapshot.items():
        if name not in stored or (mode == "replace" and name != "conversations"):
            after[name] = rows
        elif name != "manifest":
            after[name] = upsert(stored[name], rows, keys[name])
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in snapshot.items()]
    return after, reduce(DataFrame.union, counts)


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def flattened(metadata: Column) -> Column:
    """A map of strings from a VARIANT object: strings as they are, null as the empty string, numbers, booleans, lists and
    objects as JSON text."""
    return F.transform_values(F.try_variant_get(metadata, "$", "map<string,variant>"), lambda _, v: F.coalesce(F.when(F.is_variant_null(v), F.lit("")), F.try_variant_get(v, "$", "string"), F.to_json(v)))


def by_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The stored rows with one of the ids, once each."""
    return stored.join(ids.select(key).distinct(), key, "left_semi")


def cleared(stored: DataFrame) -> DataFrame:
    """The table without rows, as it is after a clear."""
    return stored.limit(0)
