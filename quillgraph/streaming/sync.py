"""Incremental sync: file states are compared, only changed files are opened and parsed, only edges of changed
notes and of notes whose links the change of the note set shifts are made anew, and a new version is published.
``Indexer`` runs it on a trigger, with texts open in an editor laid over the files."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import note_id
from quillgraph.operators import resolve, search
from quillgraph.sources import files as files_
from quillgraph.sources.config import Config
from quillgraph.sources.snapshot import SnapshotStore, changes, upsert


@dataclass(frozen=True)
class Outcome:
    full: bool
    synced: int
    deleted: int
    notes: int
    resources: int
    relinked: int = 0


def sync(spark: SparkSession, root: str, cfg: Config, store: SnapshotStore, force: bool = False, overlays: dict[str, str] | None = None) -> Outcome:
    """Bring the store up to the folder's state. A changed configuration rebuilds everything.

    One writer at a time: Conflict where another sync is running. Overlays hide the files of their paths; a path
    that had one is parsed again once it is gone.
    """
    with store.writer():
        return _sync(spark, root, cfg, store, force, overlays or {})


def _sync(spark, root, cfg, store, force, overlays) -> Outcome:
    full = force or store.needs_rebuild(cfg.content_hash())
    listing = files_.listing(spark, root, cfg)
    over = spark.createDataFrame(list(overlays.items()), "rel_path string, text string") if overlays else None
    old_state = None if full else store.current("file_state")
    state = files_.fingerprints(listing, old_state)
    if over is not None:
        seen = over.select("rel_path", F.sha2("text", 256).alias("_o"))
        state = state.join(seen, "rel_path", "left").select("rel_path", "size", F.when(F.col("_o").isNull(), F.col("mtime")).alias("mtime"), F.coalesce("_o", "content_hash").alias("content_hash"))
    at = store.write("file_state", state)
    state = store.read(at)
    moved = state.select("rel_path", F.lit("added").alias("change")) if old_state is None else changes(old_state, state, "rel_path", "content_hash")
    synced, deleted = moved.where("change <> 'deleted'").count(), moved.where("change = 'deleted'").count()
    relinked = 0
    if full or synced or deleted:
        touched = moved.where("change <> 'deleted'").select("rel_path")
        gone = moved.where("change = 'deleted'").select("rel_path")
        # a note that goes may have hidden another file of its id, which is read now
        ids = gone.select(note_id(F.col("rel_path"), cfg.vault.id_strip_prefix).alias("_id"))
        hidden = listing.select("rel_path", note_id(F.col("rel_path"), cfg.vault.id_strip_prefix).alias("_id")).join(ids, "_id", "left_semi").select("rel_path")
        changed = listing.join(touched.unionByName(hidden), "rel_path", "left_semi")
        fresh = store.read(store.write("notes_changed", files_.read_notes(changed, cfg, over)))
        if full:
            notes_at = store.write("notes", files_.last_of_id(fresh))
            notes = store.read(notes_at)
            edges = files_.graph_edges(notes, cfg)
            resources = files_.read_resources(listing, cfg)
        else:
            before = store.current("notes")
            notes_at = store.write("notes", files_.last_of_id(upsert(before, fresh, "path", gone.withColumnRenamed("rel_path", "path"))))
            notes = store.read(notes_at)
            new = notes.join(fresh.select("path"), "path", "left_semi").select("id")
            # notes that stay as they are and have a link that now leads elsewhere
            stay = notes.join(new, "id", "left_anti")
            shifted = resolve.shifted(files_.note_targets(stay, cfg), before, notes).select(F.col("src").alias("id")).distinct()
            shifted = store.read(store.write("relinked", shifted))
            relinked = shifted.count()
            again = new.unionByName(shifted)
            kept = store.current("edges").join(again.withColumnRenamed("id", "src"), "src", "left_anti").join(notes.select(F.col("id").alias("src")), "src", "left_semi")
            edges = kept.unionByName(files_.graph_edges(notes.join(again, "id", "left_semi"), cfg, notes))
            resources = _resources(listing, cfg, store.current("resources"), touched)
        index = search.index_tables(notes.select("id", F.concat_ws(" ", "title", "body_text").alias("text")))
        store.publish(
            {"notes": notes_at, "edges": edges, "resources": resources, "file_state": at, **index},
            cfg.content_hash(), {"edges": ["edge"], "postings": ["bucket"], "terms": ["bucket"]},
        )
    elif over is not None or old_state is not None and old_state.where("mtime is null").limit(1).count():
        store.publish({"file_state": at})
    return Outcome(full, synced, deleted, store.current("notes").count(), store.current("resources").count(), relinked)


def _resources(listing: DataFrame, cfg: Config, old: DataFrame, touched: DataFrame) -> DataFrame:
    """The resources table after a change: rows whose file or metadata file changed or came or went are read anew."""
    if cfg.resources is None:
        return old
    meta = files_.meta_paths(listing.where("layer = 'resource'"), listing).where("meta_path is not null")
    same = old.select("rel_path", F.col("meta_path").alias("_m"))
    hit = touched.withColumnRenamed("rel_path", "_t")
    by_file = meta.join(hit, F.col("rel_path") == F.col("_t"), "left_semi").unionByName(meta.join(hit, F.col("meta_path") == F.col("_t"), "left_semi")).select("rel_path")
    moved = meta.join(same, "rel_path", "left").where(~F.col("meta_path").eqNullSafe(F.col("_m"))).select("rel_path")
    again = by_file.unionByName(moved).distinct()
    kept = old.join(again, "rel_path", "left_anti").join(meta.select("rel_path"), "rel_path", "left_semi")
    return kept.unionByName(files_.read_resources(listing, cfg, again))


class Indexer:
    """The loop that keeps a store up to date: ticks, texts open in an editor, and requests to sync or to stop.

    A tick syncs when the folder has been quiet for ``debounce`` seconds and differs from what was synced last.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: Config, store: SnapshotStore, debounce: float = 0.4):
        self.spark, self.root, self.cfg, self.store, self.debounce = spark, root, cfg, store, debounce
        self.overlays: dict[str, str] = {}
        self.synced = self.seen = None
        self.since = 0.0
        self.query = None

    def _signature(self) -> tuple:
        files = files_.listing(self.spark, self.root, self.cfg)
        return (*files.agg(F.count("*"), F.max("mtime"), F.sum("size"), F.bit_xor(F.xxhash64("rel_path", "size", "mtime"))).first(), tuple(sorted(self.overlays.items())))

    def tick(self) -> Outcome | None:
        now, sign = time.time(), self._signature()
        if sign != self.seen:
            self.seen, self.since = sign, now
        if sign == self.synced or now - self.since < self.debounce:
            return None
        return self.sync_now()

    def sync_now(self) -> Outcome:
        sign = self._signature()
        out = sync(self.spark, self.root, self.cfg, self.store, overlays=self.overlays)
        self.synced = sign
        return out

    def open(self, rel_path: str, text: str) -> None:
        """A text as an editor has it; it hides the file until closed."""
        self.overlays[rel_path] = text

    def close(self, rel_path: str) -> None:
        self.overlays.pop(rel_path, None)

    def start(self, checkpoint: str, seconds: float = 0.4):
        """Tick on a processing-time trigger; a file source would miss deletions and rewrites."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        w = ticks.writeStream.foreachBatch(lambda _, __: self.tick() and None).option("checkpointLocation", checkpoint)
        self.query = w.trigger(processingTime=f"{seconds} seconds").start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None


def watch(spark: SparkSession, root: str, cfg: Config, store: SnapshotStore, checkpoint: str, seconds: float = 0.4):
    """A streaming query that keeps the store up to date."""
    return Indexer(spark, root, cfg, store, seconds).start(checkpoint, seconds)


def overlay(disk: DataFrame, open_texts: DataFrame) -> DataFrame:
    """``(rel_path, text)`` where a text open in an editor hides the file's."""
    o = open_texts.select("rel_path", F.col("text").alias("_o"))
    return disk.select("rel_path", F.col("text").alias("_d")).join(o, "rel_path", "full_outer").select("rel_path", F.coalesce("_o", "_d").alias("text"))


def last_events(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key of a batch; equal times go to the greater row."""
    rest = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("e")).select(key, "e.*")


def upsert_stream(source: DataFrame, store: SnapshotStore, name: str, key: str, order: str, checkpoint: str):
    """Keep a table with the last event of each key of a stream."""

    def apply(batch: DataFrame, _: int) -> None:
        last = last_events(batch, key, order)
        old = store.current(name)
        if old is not None:
            last = last_events(old.unionByName(last), key, order)
        store.publish({name: last})

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
