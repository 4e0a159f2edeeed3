"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, exact, mixing, ngram_join, quality
from .common import materialise


def quality_rules(spark, docs, sf_dir):
    """Documents that the fixed and the adaptive quality rules keep.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows are judged
    alike and all stay or go; an empty table gives an empty one. Other columns may have any names. Texts are read whole.
    """
    return quality.keep_good(docs)


def exact_dedup(spark, docs, sf_dir):
    """One document of each group that is equal without white space: most code points, then least id, null ids last.

    Null and empty texts are one group; of rows that tie in both, one stays, the least by a hash of all columns; an empty
    table gives an empty one. Other columns may have any names. Texts are read whole.
    """
    return exact.exact_dedup(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each component of five-word shingle sets at a similarity of 0.8 or more: that of the least id, null ids last.

    Null and empty texts link with nothing and all stay; of a repeated row one stays; an empty table gives an empty one.
    Other columns may have any names. Texts are read whole.
    """
    return ngram_join.near_dedup(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them: 0, 1 or 2 times, to the nearest.

    Rows are told apart by their id and a hash of all columns; rows equal in all of them come as often as all of them
    are taken together. A null source is a source, null and empty texts have no words and are not taken, and an empty
    table gives an empty one. Other columns may have any names.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    sized = materialise(docs.select("doc_id", "source", key.alias("key"), mixing.word_count().alias("size")))
    taken = mixing.mix(sized, "size", [3.0, 1.0, 2.0], 1.5)
    times = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.greatest(F.col("size"), F.lit(1))).cast("int")
    chosen = taken.select("doc_id", "key", times.alias("times")).groupBy("doc_id", "key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("rows"))
    chosen = materialise(chosen.filter("times > 0").select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "times", "rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").alias("id"), key.alias("key"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    once = rows.join(chosen.filter("rows = 1"), same).select("whole", copies.alias("copy")).select("whole.*")
    many = chosen.filter("rows > 1")
    if many.isEmpty():
        return once
    one = rows.join(many, same, "left_semi").groupBy("id", "key").agg(F.first("whole").alias("whole"))
    return once.unionByName(one.join(many, same).select("whole", copies.alias("copy")).select("whole.*"))


def encode(spark, docs, sf_dir):
    """The columns of documents with n_tokens, ids (packed) and their decoding, with an underscore where documents has that name.

    Null and empty texts have no ids and decode to nothing; repeated rows are coded alike; an empty table gives an empty
    one. Texts are read whole.
    """
    return bpe.bpe_encode(docs, bpe.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
