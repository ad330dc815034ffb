"""Hard negatives by threshold joins over an inverted index that leaves out what norms bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.vectors import arrow_schema, dealt, each, matrix, packed, ready, unpack, whole_numbers
from inkprint.session import materialize

#: Rows and anchors of a block, dimensions that are accumulated before bounds are looked at.
BLOCK_ROWS, ANCHOR_BLOCK, BAND = 8192, 1024, 8
#: Thresholds of the rounds for positives, as shares of the largest score that norms allow; the last
#: round has none and so finds whatever there is.
FALLING = (0.5, 0.25, 0.1)
#: First threshold for negatives, as a share of the least positive score whose window is not full.
NARROW = 0.9


def _suffix_norms(v: np.ndarray, band: int) -> np.ndarray:
    """Norms of what is left of each row from the start of each band on, and 0 after the last."""
    squares = np.add.reduceat(v.astype(float) ** 2, np.arange(0, v.shape[1], band), axis=1)
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(v), 1))], axis=1)) * (1 + 1e-12)


def postings(v: np.ndarray, norms: np.ndarray, longest: float, least: float, band: int) -> list[np.ndarray]:
    """Per band of dimensions the rows that are filed there. From the band on where a row's remaining
    norm times the longest anchor stays under the least threshold, nothing of the row is filed: what
    it shares with an anchor there alone can't bring the pair to the threshold."""
    depth = (norms[:, :-1] * longest >= least).sum(axis=1)
    return [np.flatnonzero(depth > b) for b in range(norms.shape[1] - 1)]


def threshold_join(
    v: np.ndarray, anchors: np.ndarray, at_least: np.ndarray, band: int = BAND
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with score >= ``at_least[anchor]``.

    Partial scores grow band by band over the postings. After a band a pair goes on only if its
    partial score and the product of the remaining norms can reach the threshold. Few pairs left:
    they are followed one by one. Survivors are verified on all dimensions.
    """
    nothing = np.zeros(0, dtype=np.int64)
    if not len(v) or not len(anchors):
        return nothing, nothing, nothing
    if not v.shape[1]:
        i, j = np.nonzero(np.broadcast_to((at_least <= 0)[:, None], (len(anchors), len(v))))
        return i, j, np.zeros(len(i), dtype=np.int64)
    mine, theirs = _suffix_norms(v, band), _suffix_norms(anchors, band)
    filed = postings(v, mine, float(theirs[:, 0].max()), float(at_least.min()), band)
    rows = filed[0]  # rows that are filed nowhere can't reach any threshold
    slack = 1e-9 * (mine[:, 0].max() * theirs[:, 0].max()) + 1e-6
    part = np.zeros((len(anchors), len(rows)))
    alive = np.ones(part.shape, dtype=bool)
    i = j = score = None
    for b, own in enumerate(filed):
        a, e = b * band, min((b + 1) * band, v.shape[1])
        if i is None:
            # rows that are filed here no longer keep what was found at their last band
            here = slice(None) if len(own) == len(rows) else np.searchsorted(rows, own)
            part[:, here] += anchors[:, a:e] @ v[own, a:e].T
            hope = part[:, here] + theirs[:, b + 1][:, None] * mine[own, b + 1]
            alive[:, here] &= hope + slack >= at_least[:, None]
            if alive.mean() < 0.125 or b + 1 == len(filed):
                i, k = np.nonzero(alive)
                j, score = rows[k], part[i, k]
        else:
            filed_here = np.zeros(len(v), dtype=bool)
            filed_here[own] = True
            hit = np.flatnonzero(filed_here[j])
            x, y = i[hit], j[hit]
            score[hit] += np.einsum("ij,ij->i", anchors[x, a:e], v[y, a:e])
            keep = np.ones(len(i), dtype=bool)
            keep[hit] = score[hit] + theirs[x, b + 1] * mine[y, b + 1] + slack >= at_least[x]
            i, j, score = i[keep], j[keep], score[keep]
    exact = np.concatenate([
        np.einsum("ij,ij->i", anchors[i[s : s + 65536]], v[j[s : s + 65536]]) for s in range(0, len(i), 65536)
    ]) if len(i) else nothing
    keep = exact >= at_least[i]
    return i[keep], j[keep], exact[keep].astype(np.int64)


def _first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score, then rising id."""
    order = np.lexsort((ids, -scores, groups))
    own = groups[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def _ranks(ids: list) -> np.ndarray:
    names = {i: r for r, i in enumerate(sorted(set(ids)))}
    return np.array([names[i] for i in ids], dtype=np.int64)


def _same(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids that are equal on both sides where the ids are."""
    names = {i: r for r, i in enumerate(dict.fromkeys([*left, *right]))}
    return np.array([names[i] for i in left], dtype=np.int64), np.array([names[i] for i in right], dtype=np.int64)


def _round(blocks: DataFrame, count: int, asked: DataFrame, order: list[int], kind: str, pick, out: str) -> DataFrame:
    """Join all blocks of rows with blocks of anchors; ``pick`` chooses from the pairs that pass."""
    anchors, parts = dealt(asked, ANCHOR_BLOCK, "part")
    extra = anchors.select("part", "key", "windows").groupBy("part").agg(
        F.collect_list(F.struct("key", "windows")).alias("more")
    )
    # the windows of a block travel by the anchor's key, beside its packed vectors
    sent = packed(anchors.select("part", F.struct("key", "id").alias("id"), "label", "mark", "v"), f"struct<key:bigint,id:{kind}>", "part")
    sent = sent.join(extra, "part").withColumn("block", each("block", count))
    form = arrow_schema(blocks, out)

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return form.empty_table()
        rows, ask = mine.slice(0, 1).to_pylist()[0], theirs.slice(0, 1).to_pylist()[0]
        raw = unpack(rows["data"], rows["kind"], len(rows["ids"]))
        wide = unpack(ask["data"], ask["kind"], len(ask["ids"]))
        v, q = ready(raw, wide)
        places = [d for d in order if d < v.shape[1]]
        i, j, s = threshold_join(v[:, places], q[:, places], np.array(ask["marks"]))
        ours, own = _same(rows["ids"], [a["id"] for a in ask["ids"]])
        keep = ours[j] != own[i]
        i, j, s = i[keep], j[keep], s[keep]
        same = np.array(rows["labels"])[j] == np.array(ask["labels"])[i]
        windows = {m["key"]: m["windows"] for m in ask["more"]}
        keys = [a["key"] for a in ask["ids"]]
        got = pick(i, j, s, same, _ranks(rows["ids"]), [windows[k] for k in keys])
        a, w, r, score = got
        return pa.Table.from_arrays([
            pa.array([keys[x] for x in a], pa.int64()), pa.array(w, pa.int32()),
            pa.array([rows["ids"][x] for x in r], form.field("id").type), pa.array(score, pa.int64()),
        ], schema=form)

    return (
        blocks.withColumn("part", each("part", parts)).groupBy("block", "part")
        .cogroup(sent.groupBy("block", "part")).applyInArrow(work, out)
    )


def mine(
    rows: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 5,
    low: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of its label, by falling inner product,
    ties to the smaller id. For each, the first ``negatives`` rows of other labels whose score is at
    most the positive's and at least ``low`` percent of it. Components count as floor(scale * x).

    Rows without id, label or vector, or with a null or non-finite component, take no part; shorter vectors
    end in zeros. Rows of the anchor's id are never its positives or negatives; repeated rows count each,
    and a repeated anchor has its results twice. A window of a negative positive score is empty.

    Scores are found by threshold joins, all rows of a score or more, with thresholds that fall
    from round to round for the anchors that still lack positives or whose windows aren't full.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    marked = whole_numbers(
        rows.where(F.col(id_col).isNotNull() & label.isNotNull()), vector_col,
        [F.col(id_col).alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("ask")], scale,
    )
    dealt_rows, count = dealt(marked, block_rows)
    table = materialize(dealt_rows.withColumn("key", F.monotonically_increasing_id()))
    blocks = materialize(packed(table.select("block", "id", "label", F.lit(0.0).alias("mark"), "v"), kind))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = (table.agg(F.max(norm).alias("n")).first()["n"] or 0.0) ** 0.5
    order = _by_energy(table)
    windows = F.array().cast("array<struct<no:int,score:bigint>>")
    anchors = materialize(table.where("ask").select(
        "key", "id", "label", "v", (F.sqrt(norm) * longest).alias("most"), windows.alias("windows")
    ))
    out = f"key long, no int, id {kind}, score long"

    def nearest(i, j, s, same, rank, _):
        i, j, s = i[same], j[same], s[same]
        best = _first(i, s, rank[j], positives)
        return i[best], np.zeros(len(best), dtype=np.int32), j[best], s[best]

    left, found = anchors, []
    for share in [*FALLING, None]:
        mark = F.lit(float("-inf")) if share is None else F.col("most") * share
        got = _round(blocks, count, left.withColumn("mark", mark), order, kind, nearest, out)
        got = materialize(_rank(got, ["key"], positives).select("key", "rank", "id", "score"))
        full = got.where(F.col("rank") == positives).select("key")
        found.append(got if share is None else got.join(full, "key", "left_semi"))
        left = materialize(left.join(full, "key", "left_anti"))
        if left.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs)
    # Windows of a positive score of at least 0; below there is no number between low percent of it and itself.
    open_ = pairs.where("score >= 0").select("key", F.struct(F.col("rank").alias("no"), "score").alias("w"))
    found = []
    for narrow in (True, False):
        asked = open_.groupBy("key").agg(F.collect_list("w").alias("windows"), F.min("w.score").alias("least"))
        floor = F.floor(F.col("least") * F.lit(NARROW)) if narrow else F.col("least") * low / 100 - 1
        asked = materialize(anchors.drop("windows").join(asked, "key").withColumn("mark", floor.cast("double")))
        if asked.isEmpty():
            break
        got = _round(blocks, count, asked, order, kind, _fill(negatives, low), out)
        got = materialize(_rank(got, ["key", "no"], negatives))
        if not narrow:
            found.append(got)
            break
        full = materialize(got.where(F.col("rank") == negatives).select("key", "no"))
        found.append(got.join(full, ["key", "no"], "left_semi"))
        open_ = open_.join(full.withColumnRenamed("no", "_no"), (open_["key"] == full["key"]) & (F.col("w.no") == F.col("_no")), "left_anti")
    result = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not found:
        return rows.sparkSession.createDataFrame([], result)
    chosen = found[0].union(found[1]) if len(found) > 1 else found[0]
    names = anchors.select("key", F.col("id").alias("anchor_id"))
    own = pairs.select("key", F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(own, ["key", "no"]).join(names, "key").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def _fill(negatives: int, low: int):
    """Per anchor and window the first rows of other labels inside it."""
    def pick(i, j, s, same, rank, windows):
        i, j, s = i[~same], j[~same], s[~same]
        cuts = np.searchsorted(i, np.arange(len(windows) + 1))  # pairs come sorted by anchor
        a, w, r, score = [], [], [], []
        for x, own in enumerate(windows):
            js, ss = j[cuts[x] : cuts[x + 1]], s[cuts[x] : cuts[x + 1]]
            for window in own:
                inside = np.flatnonzero((low * window["score"] <= 100 * ss) & (ss <= window["score"]))
                inside = inside[np.lexsort((rank[js[inside]], -ss[inside]))[:negatives]]
                a += [x] * len(inside)
                w += [window["no"]] * len(inside)
                r += js[inside].tolist()
                score += ss[inside].tolist()
        return a, w, r, score

    return pick


def _rank(got: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_energy(table: DataFrame) -> list[int]:
    """Dimensions by falling sum of squares, so that remaining norms shrink early."""
    def work(batches):
        for batch in batches:
            energy = (matrix(batch.column("v")).astype(float) ** 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(energy)), pa.int32()), pa.array(energy, pa.float64())], names=["d", "e"]
            )

    sums = table.select("v").mapInArrow(work, "d int, e double").groupBy("d").agg(F.sum("e").alias("e"))
    return [r["d"] for r in sums.orderBy(F.desc("e"), "d").collect()]
