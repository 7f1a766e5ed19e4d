"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import crosssplit, cutting, encoding, neighbours, packing, replies, splits, subjects
from quillgraph.runtime import Scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = splits.related_groups(table(spark, sf_dir, "sft_pairs"), Scratch(spark, "p1"))
    return groups.where("group_id <> pair_id").select("group_id", "pair_id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "p1")
    groups = scratch.keep(splits.related_groups(table(spark, sf_dir, "sft_pairs"), scratch))
    return splits.balanced_splits(groups).select("pair_id", "split")


def p1_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: pairs, groups, and groups that lie in more than one split."""
    scratch = Scratch(spark, "p1")
    s = splits.balanced_splits(scratch.keep(splits.related_groups(table(spark, sf_dir, "sft_pairs"), scratch)))
    g = s.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return g.agg(F.sum("n").alias("pairs"), F.count("*").alias("groups"), F.count_if(F.col("splits") > 1).alias("straddling"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosssplit.overlaps(table(spark, sf_dir, "sft_pairs"), Scratch(spark, "p2"))
    return found.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return crosssplit.class_links(table(spark, sf_dir, "sft_pairs"), Scratch(spark, "p2"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.report(*_links(spark, sf_dir), table(spark, sf_dir, "sft_pairs"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal texts, with the number of records on each side."""
    return crosssplit.linked_classes(*_links(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.defects(table(spark, sf_dir, "training_records"), table(spark, sf_dir, "answers"), Scratch(spark, "p3"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("tbl", "defect").agg(F.count("*").alias("n"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(neighbours.usable(table(spark, sf_dir, "notes")), Scratch(spark, "p4"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(p4_neighbours(spark, sf_dir), 0.75)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pieces(table(spark, sf_dir, "resources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 0").select("rel_path")


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each cut body put together again, each piece after the first without its overlap."""
    p = p5_pieces(spark, sf_dir)
    own = F.when(F.col("piece") == 0, F.col("piece_text")).otherwise(F.substring("piece_text", cutting.OVERLAP + 1, 1 << 30))
    parts = F.array_sort(F.collect_list(F.struct("piece", own.alias("t"))))
    return p.groupBy("rel_path").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256).alias("sha"), (F.max(F.octet_length("piece_text")) <= cutting.LIMIT).alias("fits"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_table(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encoding.encode_table(docs)
    back = ids.select("doc_id", encoding.decode_column(spark, F.col("ids")).alias("back"))
    joined = docs.join(back, "doc_id")
    return joined.groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("same")).agg(F.count("*").alias("n"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in tenths."""
    per = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    tenth = F.floor(F.col("used") * 10 / packing.CAPACITY).cast("int")
    return per.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


def p7_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed, containers above the capacity, and documents whose pieces leave a gap or were cut without need."""
    c = p7_containers(spark, sf_dir)
    full = c.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    d = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.count("*").alias("pieces"))
    bad = (F.col("n") != F.col("upto")) | ((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY))
    return d.agg(F.count("*").alias("documents"), F.count_if(bad).alias("broken")).crossJoin(full)  # one row each


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, subject, share)``."""
    return subjects.subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), Scratch(spark, "p8"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, cleaned lang and subject."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang"))
    return p8_found(spark, sf_dir).join(docs, "doc_id").groupBy("source", "lang", "subject").agg(F.count("*").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_integrity, p2_found, p2_report, p2_classes, p3_found, p3_counts, p4_found, p4_neighbours, p5_found, p5_pieces, p5_rejoined, p6_ids, p6_roundtrip, p7_containers, p7_fill, p7_integrity, p8_found, p8_shares, p8_composition)
}
