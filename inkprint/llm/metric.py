"""Exact search for the largest inner products: paged M-trees, searched best first."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.vectors import arrow_schema, dealt, each, matrix, pack, packed, ready, unpack, whole_numbers
from inkprint.session import materialize

#: Rows of a tree, entries of a page, routing objects that deal the rows to trees, queries of a block.
TREE_ROWS, PAGE, MOST_PIVOTS, QUERY_BLOCK = 8192, 256, 1024, 4096
#: Routing objects are sent to all tasks: no more components than this in all.
PIVOT_CELLS = 1 << 20
PAGES = ("tree int, page int, leaf boolean, ids array<{id}>, asks array<boolean>, children array<int>, "
         "apart array<double>, radius array<double>, norm array<double>, data binary, kind string")


def _norms(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def _apart(products: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances from inner products and squared norms."""
    return np.sqrt(np.maximum(left + right - 2.0 * products, 0.0))


@dataclass
class Page:
    """A metric node: its entries' objects, their distances to the node's own routing object, and for
    inner nodes covering radius, largest squared norm and page of each subtree."""

    leaf: bool
    v: np.ndarray
    apart: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    children: np.ndarray  # rows of the tree in a leaf


def grow(v: np.ndarray, page: int = PAGE) -> list[Page]:
    """An M-tree over the rows of a matrix, built from the top: a node takes evenly spaced rows as
    routing objects, deals its rows to the nearest and does the same inside each part."""
    norm = _norms(v).astype(float)
    pages: list[Page] = []

    def node(rows: np.ndarray, router: int | None) -> int:
        def to_router(own: np.ndarray) -> np.ndarray:
            if router is None:
                return np.zeros(len(own))
            return _apart((v[own] @ v[router]).astype(float), norm[own], norm[router])

        place = len(pages)
        if len(rows) <= page:
            pages.append(Page(True, v[rows], to_router(rows), np.zeros(len(rows)), norm[rows], rows))
            return place
        pages.append(None)
        count = int(min(page, -(-len(rows) // page) * 2))
        seeds = rows[np.linspace(0, len(rows) - 1, count).astype(np.int64)]
        products = (v[rows] @ v[seeds].T).astype(float)
        nearest = np.argmin(norm[seeds][None, :] - 2.0 * products, axis=1)
        parts = [(s, rows[nearest == k]) for k, s in enumerate(seeds.tolist())]
        parts = [(s, p) for s, p in parts if len(p)]
        if len(parts) == 1:  # all alike
            parts = [(int(p[0]), p) for p in np.array_split(rows, count)]
        routers = np.array([s for s, _ in parts])
        children = np.array([node(p, s) for s, p in parts], dtype=np.int64)
        far = [_apart((v[p] @ v[s]).astype(float), norm[p], norm[s]).max() for s, p in parts]
        pages[place] = Page(
            False, v[routers], to_router(routers), np.array(far),
            np.array([norm[p].max() for _, p in parts]), children,
        )
        return place

    if len(v):
        node(np.arange(len(v)), None)
    return pages


def search(
    pages: list[Page], order: np.ndarray, queries: np.ndarray, own: list[np.ndarray], floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's first k rows of a tree, and the distances computed.

    ``order`` ranks the rows among equal scores, ``own[q]`` are rows that query q doesn't take, and
    rows under ``floors[q]`` aren't wanted. In each round every query opens its page of the highest
    bound; the queries that open one page do so together. With the distance d to a routing object, radius r
    and largest norm N, no row below scores over (|q|^2 + N^2 - (d - r)^2) / 2; before d is known the
    distance to the parent and the stored one between parent and entry bound it from below.
    """
    n = len(queries)
    size = _norms(queries).astype(float)
    floors = floors.astype(float).copy()
    bound = np.full((n, len(pages)), -np.inf)
    apart = np.zeros((n, len(pages)))
    bound[:, :1] = np.inf
    best: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
    computed = 0
    slack = lambda a, b: 1e-9 * (a + b) + 1e-6
    while len(pages):
        first = np.argmax(bound, axis=1)
        top = bound[np.arange(n), first]
        open_ = np.flatnonzero((top > -np.inf) & (top >= floors))
        if not len(open_):
            break
        bound[open_, first[open_]] = -np.inf
        by_page = open_[np.argsort(first[open_], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[by_page])) + 1
        for some in np.split(by_page, cuts):
            at = int(first[some[0]])
            p = pages[at]
            if at:
                near = np.maximum(np.abs(apart[some, at][:, None] - p.apart) - p.radius, 0.0)
            else:
                near = np.zeros((len(some), len(p.apart)))
            both = size[some][:, None] + p.norm
            hope = (both - near * near) / 2 + slack(size[some][:, None], p.norm)
            want = hope >= floors[some][:, None]
            if not want.any():
                continue
            if want.mean() > 0.25:
                products = (queries[some] @ p.v.T).astype(float)
                computed += want.size
            else:
                i, j = np.nonzero(want)
                products = np.full(want.shape, -np.inf)
                products[i, j] = np.einsum("ij,ij->i", queries[some[i]], p.v[j])
                computed += len(i)
            if p.leaf:
                i, j = np.nonzero(want & (products >= floors[some][:, None]))
                for q, row, score in zip(some[i].tolist(), p.children[j].tolist(), products[i, j].tolist()):
                    if score >= floors[q] and row not in own[q]:
                        mine = best[q]
                        mine.append((-score, int(order[row]), row))
                        mine.sort()
                        if len(mine) >= k:
                            del mine[k:]
                            floors[q] = max(floors[q], -mine[-1][0])
                continue
            i, j = np.nonzero(want)
            kin = _norms(p.v).astype(float)
            d = _apart(products[i, j], size[some[i]], kin[j])
            low = np.maximum(d - p.radius[j], 0.0)
            bound[some[i], p.children[j]] = (size[some[i]] + p.norm[j] - low * low) / 2 + slack(size[some[i]], p.norm[j])
            apart[some[i], p.children[j]] = d
    found = [(q, row, -score) for q, mine in enumerate(best) for score, _, row in mine]
    asked = np.array([f[0] for f in found], dtype=np.int64)
    rows = np.array([f[1] for f in found], dtype=np.int64)
    return asked, rows, np.array([f[2] for f in found], dtype=float).astype(np.int64), computed


def _ranks(ids: list) -> np.ndarray:
    """Place of each row in the order of ids; equal ids keep their order."""
    out = np.empty(len(ids), dtype=np.int64)
    out[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return out


def _own(ids: list, asked: list) -> list[set[int]]:
    places: dict = {}
    for row, i in enumerate(ids):
        places.setdefault(i, set()).add(row)
    return [places.get(i, set()) for i in asked]


def _load(table: pa.Table) -> tuple[list[Page], np.ndarray, list, np.ndarray]:
    """Pages of a tree from its rows, all objects as one matrix, and ids and marks of its rows."""
    parts = sorted(table.to_pylist(), key=lambda r: r["page"])
    pages, ids, asks, own = [], [], [], []
    for r in parts:
        v = unpack(r["data"], r["kind"], len(r["apart"]))
        children = np.array(r["children"], dtype=np.int64)
        if r["leaf"]:
            children = len(ids) + np.arange(len(r["ids"]))
            ids += r["ids"]
            asks += r["asks"]
            own.append(v)
        pages.append(Page(r["leaf"], v, *(np.array(r[c], dtype=float) for c in ("apart", "radius", "norm")), children))
    return pages, np.concatenate(own), ids, np.array(asks, dtype=bool)


def _pivots(rows: DataFrame, count: int, seen: int) -> np.ndarray:
    """Routing objects: the ``seen`` rows of the smallest hashes, at most PIVOT_CELLS components."""
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    seen = max(1, min(seen, PIVOT_CELLS // max(width, 1)))
    some = rows.orderBy(F.xxhash64("v", "id")).limit(seen).select("v").collect() if count else []
    return np.unique(matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64()))), axis=0)


def index(rows: DataFrame, tree_rows: int = TREE_ROWS, page: int = PAGE) -> tuple[DataFrame, int]:
    """Pages of a forest over (id, ask, v), and the number of trees.

    Rows go to their nearest of at most ``MOST_PIVOTS`` routing objects (a sample whose size is that of
    the forest up to there; every row is indexed), and a routing object with more rows than a tree holds
    has several trees, dealt evenly, so that neither copies nor clusters crowd one task.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = materialize(rows)
    count = rows.count()
    pivots = _pivots(rows, count, min(MOST_PIVOTS, -(-count // tree_rows)))

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                v, p = ready(matrix(batch.column("v")), pivots)
                near = np.argmin(_norms(p)[None, :] - 2 * (v @ p.T), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "pivot"]
                )

    near = materialize(rows.mapInArrow(nearest, f"id {kind}, ask boolean, v array<long>, pivot int"))
    sizes = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}
    trees, at = [], 0
    for p in range(max(1, len(pivots))):
        parts = max(1, -(-sizes.get(p, 0) // tree_rows))
        trees.append((at, parts))
        at += parts if sizes.get(p) else 0
    start = F.array(*[F.lit(a) for a, _ in trees])[F.col("pivot")]
    parts = F.array(*[F.lit(b) for _, b in trees])[F.col("pivot")]
    placed = near.withColumn(
        "tree", (start + F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)).cast("int")
    )

    def build(table: pa.Table) -> pa.Table:
        ids, asks = table["id"].to_pylist(), table["ask"].to_pylist()
        raw = matrix(table["v"])
        out = []
        for no, p in enumerate(grow(ready(raw)[0], page)):
            data, form = pack(p.v.astype(np.int64))
            own = p.children.tolist() if p.leaf else []
            out.append((
                table["tree"][0].as_py(), no, p.leaf, [ids[r] for r in own], [asks[r] for r in own],
                [] if p.leaf else p.children.tolist(), p.apart.tolist(), p.radius.tolist(), p.norm.tolist(), data, form,
            ))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form_of)], schema=form_of)

    form_of = arrow_schema(near, PAGES.format(id=kind))
    pages = placed.select("tree", "id", "ask", "v").groupBy("tree").applyInArrow(build, PAGES.format(id=kind))
    return materialize(pages), at


def nearest(
    rows: DataFrame, ask: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, tree_rows: int = TREE_ROWS, page: int = PAGE, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the largest inner product for each row that ``ask``
    marks, ties to the smaller id.

    Components count as floor(scale * x), so that scores are exact integers. Rows without id, without
    vector, or with a null or non-finite component take no part; shorter vectors end in zeros; an empty vector scores 0
    with all. Candidates are all rows of another id than the query's: of repeated rows each is a candidate, and each asked one a query with
    a result of its own. Scores beyond 64 bits are an error. Other columns don't matter.

    A query is first searched in the tree that holds it. Its k-th score there is the floor with which
    it goes, in blocks, to all other trees; most of their pages are closed by it unless vectors have no structure.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    marked = whole_numbers(
        rows.where(F.col(id_col).isNotNull()), vector_col,
        [F.col(id_col).alias("id"), F.coalesce(ask, F.lit(False)).alias("ask")], scale,
    )
    pages, trees = index(marked, tree_rows, page)
    if not trees:
        return rows.sparkSession.createDataFrame(
            [], f"query_id {kind}, rank int, {id_col} {kind}, score long"
        )
    first_form = f"tree int, no int, id {kind}, v array<long>, mark double, hits array<struct<id:{kind},score:bigint>>"
    first_arrow = arrow_schema(pages, first_form)

    def at_home(table: pa.Table) -> pa.Table:
        tree, raw, ids, asks = _load(table)
        who = np.flatnonzero(asks)
        asked = [ids[w] for w in who]
        tree, queries = _exact(tree, raw, raw[who])
        q, r, s, _ = search(tree, _ranks(ids), queries, _own(ids, asked), np.full(len(who), -np.inf), k)
        hits = [[] for _ in who]
        for a, b, c in zip(q.tolist(), r.tolist(), s.tolist()):
            hits[a].append({"id": ids[b], "score": c})
        floors = [h[-1]["score"] if len(h) >= k else float("-inf") for h in hits]
        return pa.Table.from_arrays([
            pa.array([table["tree"][0].as_py()] * len(who), pa.int32()), pa.array(who, pa.int32()),
            pa.array(asked, first_arrow.field("id").type), pa.array(raw[who].tolist(), pa.list_(pa.int64())),
            pa.array(floors, pa.float64()), pa.array(hits, first_arrow.field("hits").type),
        ], schema=first_arrow)

    home, blocks = dealt(pages.groupBy("tree").applyInArrow(at_home, first_form), block)
    key = F.col("tree").cast("long") * F.lit(1 << 32) + F.col("no")
    home = materialize(home.withColumn("label", key))
    asked = packed(home.select("block", "id", "label", "mark", "v"), kind)
    far_form = f"key long, id {kind}, score long"
    far_arrow = arrow_schema(pages, far_form)

    def elsewhere(mine: pa.Table, others: pa.Table) -> pa.Table:
        empty = far_arrow.empty_table()
        if not mine.num_rows or not others.num_rows:
            return empty
        b = others.slice(0, 1).to_pylist()[0]
        keys = np.array(b["labels"], dtype=np.int64)
        away = np.flatnonzero(keys >> 32 != mine["tree"][0].as_py())
        if not len(away):
            return empty
        tree, raw, ids, _ = _load(mine)
        tree, queries = _exact(tree, raw, unpack(b["data"], b["kind"], len(keys))[away])
        names = [b["ids"][w] for w in away]
        q, r, s, _ = search(tree, _ranks(ids), queries, _own(ids, names), np.array(b["marks"])[away], k)
        return pa.Table.from_arrays([
            pa.array(keys[away[q]], pa.int64()), pa.array([ids[x] for x in r], far_arrow.field("id").type),
            pa.array(s, pa.int64()),
        ], schema=far_arrow)

    far = (
        pages.withColumn("block", each("block", blocks)).groupBy("tree", "block")
        .cogroup(asked.withColumn("tree", each("tree", trees)).groupBy("tree", "block"))
        .applyInArrow(elsewhere, far_form)
    )
    near = home.select(F.col("label").alias("key"), F.explode("hits").alias("h")).select("key", "h.id", "h.score")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc("id"))
    ranked = near.union(far.select("key", "id", "score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = home.select(F.col("label").alias("key"), F.col("id").alias("query_id"))
    return ranked.join(names, "key").select("query_id", "rank", F.col("id").alias(id_col), "score")


def _exact(tree: list[Page], raw: np.ndarray, queries: np.ndarray) -> tuple[list[Page], np.ndarray]:
    """Pages and queries of one width in numbers with exact products."""
    ready(raw, queries)
    parts = ready(queries, *(p.v for p in tree), raw[:1])
    for p, v in zip(tree, parts[1:]):
        p.v = v
    return tree, parts[0]
