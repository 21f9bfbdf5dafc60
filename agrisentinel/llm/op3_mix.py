"""Mixing sources to target weights.

The words of each source, in document order, form one stream that is packed into
blocks of ``block`` words.  A source's target share is filled by slots, one block
each; an output shard is a run of ``shard_slots`` consecutive slots.

* Slots fall to sources as in a multinomial draw per shard, conditioned on the
  totals: a pseudorandom permutation of all slots maps stratum ``g`` (the
  sources' intervals laid end to end) to a slot.  Each shard's counts are thus
  random, while every source's total is its target to within half a block.
* The j-th slot of a source takes block ``P(j mod blocks)`` where P is the
  source's own permutation for the pass ``j div blocks``.  A block is taken at
  most once per pass, and there are at most ``cap`` passes, so no document
  exceeds ``cap`` times its size.
* Slots and documents meet in a join on (source, block).

Permutations are Feistel networks over hashes of the seed, so reruns agree.
Positions come from range-partitioned running totals: a source holding any share
of the rows is spread over all tasks.  Null or empty texts have size 0 and take
nothing; a null source is a source of its own, after all others; repeated rows
are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import dense_order_ids, running_totals
from . import hashing as H
from .tables import broadcast_if_small, materialise

U = np.uint64
WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_SLOTS = 4096
CAP = 3
SPACE = r"[\x20\x09-\x0D]+"
#: slots generated by one row of the slot table
RUN = 1 << 15


def words(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def permute(x: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudorandom bijection of [0, n) (element-wise n and seed): a four-round
    Feistel network on the next even number of bits, walked until inside."""
    x, n, seed = (np.asarray(v).astype(U) for v in np.broadcast_arrays(x, n, seed))
    bits = np.ceil(np.log2(np.maximum(n, U(2)).astype(np.float64)) + 1e-9).astype(np.int64)
    half = np.maximum(1, (bits + 1) // 2).astype(U)
    mask = (U(1) << half) - U(1)
    out = x.copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (H.mix(right + H.mix(seed[todo] + U(r + 1))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _place_slots(seed: int, total: int, shard_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, first, start, count, blocks = (batch.column(i).to_numpy(False) for i in range(5))
            for i in range(len(sid)):
                j = np.arange(first[i], min(first[i] + RUN, count[i]))
                slot = permute(start[i] + j, total, seed)
                own = H.mix(np.array([seed * 1_000_003 + int(sid[i])], U) + (j // blocks[i]).astype(U))
                block = permute(j % blocks[i], blocks[i], own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // shard_slots), pa.array(slot), pa.array(np.full(len(j), sid[i])), pa.array(block)],
                    names=["shard", "slot", "sid", "block"])
    return run


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sid, source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources in code-point order, null last.  A target
    stops at ``cap`` times its source's size; with sources ordered by the share
    at which they stop, those that stop are a prefix, found by running totals.
    """
    ordered = dense_order_ids(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "sid").drop("none")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ordered = materialise(ordered.withColumns({"w": w}).withColumns(
        {"most": F.col("source_size") * F.lit(float(cap)), "ratio": F.col("source_size") * F.lit(float(cap)) / F.col("w")}),
        "op3-sources")
    all_words, all_w = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    run = running_totals(ordered, [], ["ratio", "sid"], ["most", "w"])
    rest_w = F.lit(float(all_w)) - (F.col("w_cum") - F.col("w"))
    rate = (F.lit(float(all_words)) - (F.col("most_cum") - F.col("most"))) / rest_w
    run = materialise(run.withColumn("rate", rate).withColumn("full", F.col("rate") * F.col("w") > F.col("most")), "op3-rates")
    level = run.where(~F.col("full")).agg(F.max("rate")).first()[0] or 0.0
    return run.select("sid", "source", "source_size",
                      F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * float(level)).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 17, weights=WEIGHTS,
             cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, pieces, slots)``: documents with source target, the word ranges
    of documents that make up each block, and the blocks each slot takes."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        F.size(words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(text_col).alias("tkey"))
    sizes = materialise(sizes.withColumn("row", F.monotonically_increasing_id()), "op3-sizes")
    plan = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    plan = (plan.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
                .withColumn("count", F.when(F.col("blocks") > 0, F.least(
                    cap * F.col("blocks"),
                    F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0))))
    plan = materialise(running_totals(plan, [], ["sid"], ["count"]).withColumn("start", F.col("count_cum") - F.col("count")),
                       "op3-plan")
    small = broadcast_if_small(plan.select("sid", "source", "source_size", "target"), 256)
    rows = sizes.join(small, sizes["source"].eqNullSafe(small["source"])).drop(small["source"])
    stream = running_totals(rows.where("size > 0"), ["sid"], ["doc_id", "tkey", "row"], ["size"])
    begin = F.col("size_cum") - F.col("size")
    blocks = F.sequence(F.floor(begin / block), F.floor((F.col("size_cum") - 1) / block))
    pieces = (stream.withColumn("begin", begin).withColumn("block", F.explode(blocks))
                    .select("sid", "block", "row", "doc_id", "tkey",
                            F.greatest(F.col("block") * block - F.col("begin"), F.lit(0)).alias("from_word"),
                            F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size")).alias("to_word")))
    total = int(plan.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    starts = plan.where("count > 0").select(
        "sid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RUN).cast("long"))).alias("first"),
        "start", "count", "blocks")
    slots = starts.repartition(max(1, min(1 << 14, total // RUN))).mapInArrow(
        _place_slots(seed, total, shard_slots), "shard long, slot long, sid long, block long")
    return rows, pieces, slots


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``."""
    rows, pieces, slots = plan_mix(docs, **options)
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # Spark guesses the slots' size from the plan table they come from, far too small to broadcast by
    taken = (pieces.join(times.hint("merge"), ["sid", "block"]).groupBy("row")
                   .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken")))
    return rows.join(taken.hint("merge"), "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: ``shard, slot, doc_id, from_word, words`` (one row per
    piece of a slot's block; order by slot, doc_id, from_word)."""
    _, pieces, slots = plan_mix(docs, id_col=id_col, text_col=text_col, **options)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tkey"),
                        words(F.col(text_col)).alias("words")).dropDuplicates(["doc_id", "tkey"])
    pieces, slots = pieces.alias("p"), slots.alias("s")
    drawn = slots.join(pieces, (F.col("s.sid") == F.col("p.sid")) & (F.col("s.block") == F.col("p.block")))
    return (drawn.select("shard", "slot", F.col("p.doc_id").alias("piece_id"), F.col("p.tkey").alias("piece_key"),
                         "from_word", "to_word")
                 .join(texts, F.col("piece_id").eqNullSafe(F.col("doc_id")) & (F.col("piece_key") == F.col("tkey")))
                 .select("shard", "slot", "doc_id", "from_word",
                         F.slice("words", F.col("from_word").cast("int") + 1,
                                 (F.col("to_word") - F.col("from_word")).cast("int")).alias("words")))
