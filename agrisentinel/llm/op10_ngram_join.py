"""N-gram Jaccard join with PartEnum signatures.

A document's feature set is its distinct k-word shingles (64-bit hashes).  Two
sets of Jaccard similarity >= num/den differ in at most
``(den-num)/(den+num) * (|x|+|y|)`` features.  Sizes are cut into bands; a set
signs for its own band and, if a partner of it can lie there, for the next one.
Inside a band of largest size r at most ``K = 2r(den-num)/(den+num)`` features
differ, so with the feature domain cut into partitions

* K <= 3:  n = K + 3 partitions, every subset of 3 partitions is a signature
  (at least 3 partitions are untouched by K differences),
* K >= 4:  n = K + 1 + m partitions, every partition is a signature (m + 1 are
  untouched; a partition without features signs only for a set that has more
  than m such partitions - any other pair shares a non-empty one as well; and of
  its signatures a set may forgo the m most frequent ones, less its empty ones),

and two linked sets share at least one signature: no link is lost.

Equal sets are collapsed to one class first.  Members of a signature are tried
against one hub, its most central member (a star, not all pairs).  Members that
the hub leaves unconnected are tried against those members that share one of
their rarest differences from the hub (``_by_difference``), which any link needs.
Every candidate pair is checked exactly on the two shingle sets, so the
components equal those of the full similarity graph.

Null or empty texts have no shingles and link with nothing.  Rows with a null
id are returned with a null component.  Rows that repeat an id are one node of
the graph.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .components import connected_components
from .tables import broadcast_if_small, materialise, own_names, release

U = np.uint64
SCAN = ("id long, n_shingles long, set_a long, set_b long, sigs array<long>, spare long, "
        "sigs_up array<long>, spare_up long")


def size_bands(num: int, den: int, largest: int) -> np.ndarray:
    """Lower edges of the size bands: consecutive edges differ by (den/num)**2 at
    least, so partners lie in the same or in neighbouring bands."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den * den // (num * num))))
    return np.array(edges, np.int64)


def max_difference(num: int, den: int, edges: np.ndarray) -> np.ndarray:
    return 2 * (edges[1:] - 1) * (den - num) // (den + num)


def _set_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums (mod 2**64) of the non-empty runs that start at ``begin``."""
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0, U)


def band_signatures(sets: np.ndarray, sizes: np.ndarray, band: np.ndarray,
                    diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (each sorted ascending, concatenated) for one band each.

    Returns ``(set index, signature, spare)``; bands of K = 0 link equal sets only
    and need none.  ``spare``: how many of a set's signatures any linked pair
    shares beyond one.
    """
    k = diff[band]
    n = np.where(k <= 3, k + 3, k + 1 + 4 + 3 * k // 10)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    base = np.cumsum(n) - n
    part = ((sets >> U(32)) * np.repeat(n, sizes).astype(U) >> U(32)).astype(np.int64)
    slot = np.repeat(base, sizes) + part
    begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    sums = np.zeros(int(n.sum()), U)
    sums[slot[begin]] = H.mix(_set_sums(H.mix(sets ^ U(0xA24BAED4963EE407)), begin) + U(1))
    seen = np.zeros(len(sums), bool)
    seen[slot[begin]] = True
    of = np.repeat(np.arange(len(sizes)), n)
    index = np.arange(len(sums)) - base[of]
    salt = H.mix((band[of].astype(U) << U(32)) + index.astype(U) + U(7))
    own, sigs = [], []
    empty = np.bincount(of, weights=~seen, minlength=len(sizes)).astype(np.int64)
    spare = np.where(k >= 4, n - k - 1, 0) - empty
    use = (k[of] >= 4) & (seen | (spare < 0)[of])
    own.append(of[use])
    sigs.append(H.mix(sums[use] ^ salt[use]))
    cell = H.mix(sums ^ salt)
    for small in (1, 2, 3):
        rows = np.flatnonzero(k == small)
        for subset in itertools.combinations(range(small + 3), 3):
            total = sum((cell[base[rows] + j] for j in subset), np.zeros(len(rows), U))
            own.append(rows)
            sigs.append(H.mix(total))
    return np.concatenate(own), np.concatenate(sigs), np.maximum(spare, 0)


def _lists(own: np.ndarray, sigs: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                                    pa.array(H.signed(sigs[order])))


def _distinct_sets(hashes: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(per_doc)
    out = [np.unique(hashes[e - c: e]) for e, c in zip(ends, per_doc)]
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U)), sizes


def _chunk_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf = H.ASCII_LOWER[buf]
    starts, ends, counts = H.word_bounds(buf, off)
    words = H.range_hash(H.prefix_sums(buf), starts, ends)
    return _distinct_sets(*H.shingles(words, counts, k))


def _scan(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = size_bands(num, den, 1 << 20)
        for batch in batches:
            ids = batch.column(0)
            buf, off = H.text_bytes(batch.column(1))
            for i, j in H.chunks(off):
                sets, sizes = _chunk_sets(buf[off[i]: off[j]], off[i: j + 1] - off[i], k)
                if len(sizes) and sizes.max() >= edges[-2]:  # the largest set signs for the band after its own, too
                    edges = size_bands(num, den, int(size_bands(num, den, int(sizes.max()))[-1]))
                diff = max_difference(num, den, edges)
                begin = np.cumsum(sizes) - sizes
                full = np.flatnonzero(sizes)
                a, b = np.zeros(len(sizes), U), np.zeros(len(sizes), U)
                a[full] = _set_sums(H.mix(sets), begin[full])
                b[full] = _set_sums(H.mix(sets ^ U(0x8EBC6AF09C88C6E3)), begin[full])
                band = np.searchsorted(edges, sizes, "right") - 1
                n = len(sizes)
                reach = -(-edges[np.minimum(band + 1, len(edges) - 1)] * num // den)
                up = np.flatnonzero((sizes > 0) & (sizes >= reach) & (band + 1 < len(diff)))
                member = np.zeros(n, bool)
                member[up] = True
                columns = []
                for rows, of_rows, at in ((full, sets, band[full]),
                                          (up, sets[np.repeat(member, sizes)], band[up] + 1)):
                    own, sigs, spare = band_signatures(of_rows, sizes[rows], at, diff)
                    every = np.zeros(n, np.int64)
                    every[rows] = spare
                    columns += [_lists(rows[own], sigs, n), pa.array(every)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.array(H.signed(a)),
                     pa.array(H.signed(b)), *columns],
                    names=["id", "n_shingles", "set_a", "set_b", "sigs", "spare", "sigs_up", "spare_up"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = H.text_bytes(batch.column(1))
            for i, j in H.chunks(off):
                sets, sizes = _chunk_sets(buf[off[i]: off[j]], off[i: j + 1] - off[i], k)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(H.signed(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), lists],
                                                 names=["id", "features"])
    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               num: int = 85, den: int = 100) -> DataFrame:
    """``id, n_shingles, set_a, set_b, sigs``: set size, 128-bit set digest, signatures."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(shingle, num, den), SCAN)


def _compared(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (src, dst) with the exact verdict, dst's set size ``n`` and ``diff``:
    the features that one of the two sets alone has, ``n_diff`` of them (stored)."""
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = materialise(ids, "op10-ids")
    sets = docs.join(broadcast_if_small(ids, 40), "id", "left_semi").mapInArrow(_sets(shingle), "id long, features array<long>")
    sets = materialise(sets, "op10-sets")
    release(ids)
    both = (pairs.join(sets.select(F.col("id").alias("dst"), F.col("features").alias("y")), "dst")
                 .join(sets.select(F.col("id").alias("src"), F.col("features").alias("x")), "src"))
    diff = both.select("src", "dst", F.size("y").alias("n"), F.size("x").alias("n_src"),
                       F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("diff"))
    n_diff = F.size("diff")
    compared = materialise(diff.select("src", "dst", "n", n_diff.alias("n_diff"), "diff",
                                       ((den + num) * n_diff <= (den - num) * (F.col("n") + F.col("n_src"))).alias("linked")),
                           "op10-compared")
    release(sets)
    return compared


def _by_difference(compared: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs still to try among the members v, w tried against one hub h (stored).

    Let X be a member's difference from h and D its size.  The sets of v and w
    differ in ``|X_v ^ X_w| = D_v + D_w - 2 |X_v & X_w|`` features, at most
    ``K = (den-num)/(den+num) (|v|+|w|)`` of them if linked, so a link needs
    ``o = ceil((D_v + D_w - K) / 2)`` common differences.  Where v does not link to
    h, ``D_v + D_w - K > D_w (1 - (den-num)/(den+num)) >= 0``, so that o >= 1.  In
    one order of all features, the first common one then has o - 1 others behind
    it on either side: it is among the first ``D - o + 1`` of both.  The order is
    by frequency under the hub, rarest first, so what most members share (such as
    a change of the hub's own) is hardly ever asked for.  Members already in one
    component are not tried; of two in different ones, one is not the hub's.
    """
    family = (compared.join(comp.select(F.col("id").alias("dst"), F.col("component").alias("of")), "dst")
                      .join(comp.select(F.col("id").alias("src"), F.col("component").alias("hub_of")), "src"))
    open_hubs = (family.groupBy("src").agg(F.count(F.lit(1)).alias("members"),
                                           F.max(F.col("of") != F.col("hub_of")).alias("open"))
                       .where("members > 1 and open").select("src"))
    family = family.join(open_hubs, "src", "left_semi")
    feature = materialise(family.select("src", "dst", "n", "n_diff", "of", (F.col("of") == F.col("hub_of")).alias("home"),
                                        F.explode("diff").alias("feature")), "op10-features")
    often = (feature.groupBy("src", "feature").agg(F.count(F.lit(1)).alias("times"), F.min("of").alias("lo"),
                                                   F.max("of").alias("hi")).where("times > 1"))
    rarest = Window.partitionBy("src", "dst").orderBy("times", "feature")
    # every feature that one member alone has comes first and leads to no pair
    common = (feature.join(often, ["src", "feature"])
                     .withColumn("place", F.col("n_diff") - F.count(F.lit(1)).over(Window.partitionBy("src", "dst"))
                                 + F.row_number().over(rarest))
                     .where((F.col("lo") < F.col("hi"))
                            & (~F.col("home") | ((den + num) * (F.col("n_diff") - F.col("place") + 1) >= num * F.col("n_diff")))))
    common = materialise(common.select("src", "feature", "dst", "n", "n_diff", "of", "home", "place"), "op10-common")
    release(feature)
    v, w = common.where("not home").alias("v"), common.alias("w")
    # twice the common differences that a link needs
    need = F.col("v.n_diff") + F.col("w.n_diff") - F.floor((den - num) * (F.col("v.n") + F.col("w.n")) / F.lit(den + num))
    near = (v.join(w, (F.col("v.src") == F.col("w.src")) & (F.col("v.feature") == F.col("w.feature"))
                   & (F.col("v.of") != F.col("w.of"))
                   & (F.col("w.home") | (F.col("v.dst") < F.col("w.dst")))
                   & (2 * (F.col("v.n_diff") - F.col("v.place") + 1) >= need)
                   & (2 * (F.col("w.n_diff") - F.col("w.place") + 1) >= need))
             .select(F.least("v.dst", "w.dst").alias("src"), F.greatest("v.dst", "w.dst").alias("dst"))
             .distinct())
    near = materialise(near, "op10-near")
    release(common)
    return near


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signs = materialise(signatures(rows, "id", "text", shingle, num, den), "op10-scan")
    scan = materialise(signs.select("id", "n_shingles", "set_a", "set_b"), "op10-sizes")
    named = signs.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialise(named.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id")), "op10-classes")
    # one row of each class signs; rows that repeat (id, set) sign alike and fall together below
    signing = named.join(classes.select(F.col("class_id").alias("id"), "set_a", "set_b"),
                         ["id", "set_a", "set_b"], "left_semi")
    # (id, band) as one number: twice the id, plus one for the next band
    signed = signing.select(F.explode("sigs").alias("sig"), (2 * F.col("id")).alias("signer")).union(
        signing.select(F.explode("sigs_up").alias("sig"), (2 * F.col("id") + 1).alias("signer")))
    by_sig = Window.partitionBy("sig")
    shared = (signed.withColumns({"first": F.min("signer").over(by_sig), "last": F.max("signer").over(by_sig),
                                  "members": F.count(F.lit(1)).over(by_sig)})
                    .where(F.shiftright("first", 1) < F.shiftright("last", 1)).select("sig", "signer", "members"))
    shared = materialise(shared, "op10-shared")
    spares = materialise(signing.select((2 * F.col("id")).alias("signer"), "spare").union(
        signing.select((2 * F.col("id") + 1).alias("signer"), F.col("spare_up").alias("spare"))
    ).groupBy("signer").agg(F.min("spare").alias("spare")), "op10-spares")
    release(signs)
    # a linked pair shares spare + 1 signatures of the band, so its rarest common one
    # is left when each member forgoes its ``spare`` most frequent ones
    hottest = Window.partitionBy("signer").orderBy(F.desc("members"), "sig")
    rare = (shared.join(spares, "signer").withColumn("rank", F.row_number().over(hottest)).where("rank > spare")
                  .select("sig", F.shiftright("signer", 1).alias("id")).distinct())
    rare = materialise(rare.withColumns({"members": F.count(F.lit(1)).over(by_sig)}).where("members > 1"), "op10-rare")
    release(shared)
    release(spares)
    # the hub of a signature is its member with the most company over all its signatures
    company = rare.groupBy("id").agg(F.sum("members").alias("company"))
    ranked = rare.join(company, "id").select(
        "sig", "id", F.struct("company", (-F.col("id")).alias("neg")).alias("rank"))
    hubs = ranked.groupBy("sig").agg((-F.max("rank")["neg"]).alias("hub"))
    tried = materialise(rare.join(hubs, "sig").where("id != hub")
                              .select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct(), "op10-star")
    nodes = materialise(rare.select("id").distinct(), "op10-nodes")
    release(rare)
    star = _compared(tried, rows, shingle, num, den)
    links = materialise(star.where("linked").select("src", "dst"), "op10-links")
    comp = materialise(connected_components(nodes, links), "op10-comp")
    both_ways = tried.union(tried.select("dst", "src"))
    near = _by_difference(star, comp, num, den)
    release(star)
    rest = materialise(near.join(both_ways, ["src", "dst"], "left_anti"), "op10-rest")
    if rest.limit(1).count():
        more = _compared(rest, rows, shingle, num, den).where("linked").select("src", "dst")
        if more.limit(1).count():
            comp = materialise(connected_components(nodes, links.union(more)), "op10-comp")
    placed_class = (classes.join(comp.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
                           .select("set_a", "set_b", F.coalesce("component", "class_id").alias("component_id")))
    return (scan.select("id", "n_shingles", "set_a", "set_b").join(placed_class, ["set_a", "set_b"], "left")
                .select("id", "n_shingles",
                        F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id")))
                         .otherwise(F.col("id")).alias("component_id")))


def keep_one_per_class(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents that link to one of a smaller id (columns kept).

    A group keeps its smallest id.  Of rows that repeat an id and its text one stays,
    the first in the order of all columns.  Where an id stands for different texts, each
    of them stays once: the id does not tell which of them links.  Rows with a null id
    stay.
    """
    found = similarity_classes(docs, shingle=shingle, num=num, den=den)
    gone = found.where("id != component_id").select(F.col("id").alias("doc_id")).distinct()
    rows, names, back = own_names(docs)
    key, text = names["doc_id"], F.xxhash64(names["text"])
    repeated = materialise(rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(text).alias("_least"), F.max(text).alias("_most")).where("_rows > 1"), "op10-repeated")
    several = repeated.where("_least != _most").select(F.col(key).alias("doc_id"))
    gone = materialise(gone.join(several, "doc_id", "left_anti"), "op10-gone").withColumnRenamed("doc_id", key)
    kept = rows.join(broadcast_if_small(gone, 40), key, "left_anti")
    if repeated.limit(1).count():
        again = broadcast_if_small(repeated.select(key), 40)
        first = F.min(F.struct(*[F.col(n) for n in names.values()])).alias("_first")
        once = (kept.join(again, key, "left_semi").groupBy(F.col(key).alias("_id"), text.alias("_text")).agg(first)
                    .select("_first.*"))
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept.select(*back)
