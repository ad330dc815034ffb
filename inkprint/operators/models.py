"""Linear models of many problems, and classifiers on small dense vectors.

The one-vs-rest tasks of a family and problem (a split and a candidate each) share their rows and the
passes over them, but every task is solved by itself: a result never depends on what other problems
are in the run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators import dual, svm
from inkprint.operators.boost import Boosted
from inkprint.operators.common import DOC, join_dimension, ordinal
from inkprint.operators.evaluate import class_report
from inkprint.operators.similarity import PAIR
from inkprint.session import materialize, side_by_side

FAMILY = ["family", "problem"]
# Solver passes. The tolerance ends nearly all tasks before.
SVM_ITERATIONS = 500
#: Problems with so many known documents at most are solved in the dual, a block in one task.
IN_PLACE_DOCS = dual.GROUP_ROWS
#: Margins of a sigmoid that are fitted in one task; larger groups take their steps by grouped sums.
IN_PLACE_MARGINS = 200_000
#: How close margins are solved: a relative duality gap, made exact for the squared hinge loss.
SOLVED_GAP = 1e-6
#: Scores of a problem whose second-level regression is solved in one task, and steps of that.
STACK_CELLS, STACK_ITERATIONS = 4_000_000, 1000
# The costs, losses and the number of folds of the published grid.
COSTS = (0.0001, 0.001, 0.01, 0.5, 1.0, 5.0, 10.0, 20.0)
LOSSES = (dual.HINGE, dual.SQUARED)
GRID_FOLDS = 5
#: Relative duality gap of the grid, where only the order of margins counts, and of kernel machines.
GRID_GAP, KERNEL_GAP = 1e-3, 1e-4
#: Passes of a grid at most; its hinge loss takes more than the squared one.
GRID_PASSES = 2000


def sparse_vector(size: int, index: Column, value: Column) -> Column:
    """The only way into a vector column for long rows: places in ascending order, one call per
    document."""
    build = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    return build(index, value)


# -- splits -----------------------------------------------------------------------


def fold_numbers(known: DataFrame, k: int, group: Sequence[str] = ("problem", "author")) -> DataFrame:
    """Stratified folds: documents of an author are dealt out in turn."""
    numbered = ordinal(known.select(*group, "doc_name"), list(group), "doc_name", "_i")
    return numbered.select(*DOC, F.pmod("_i", F.lit(k)).cast("int").alias("fold"))


def calibration_roles(known: DataFrame, unknown: DataFrame, k: int = 3) -> DataFrame:
    """(problem, doc_name, split, role): k splits, each trained without one fold, which
    calibrates it; unknown documents are scored by every split."""
    splits = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    mine = fold_numbers(known, k).withColumn("split", splits)
    role = F.when(F.col("fold") == F.col("split"), "calibrate").otherwise("train")
    tests = unknown.select(*DOC).withColumn("split", splits).withColumn("role", F.lit("test"))
    return mine.select(*DOC, "split", role.alias("role")).unionByName(tests)


def plain_roles(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """One split: train on all known documents."""
    return known.select(*DOC, F.lit(0).alias("split"), F.lit("train").alias("role")).unionByName(
        unknown.select(*DOC, F.lit(0).alias("split"), F.lit("test").alias("role"))
    )


def oof_roles(known: DataFrame, outer: int = 7, inner: int = 3) -> DataFrame:
    """Splits (outer fold x inner fold): each known document is scored only by models that
    have not seen it."""
    a = fold_numbers(known, outer * inner)
    pairs = a.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(outer * inner - 1))))
    o, i = F.floor(F.col("split") / inner), F.pmod("split", F.lit(inner))
    mine_o, mine_i = F.floor(F.col("fold") / inner), F.pmod("fold", F.lit(inner))
    role = F.when(mine_o == o, "test").when(mine_i == i, "calibrate").otherwise("train")
    return pairs.select(*DOC, F.col("split").cast("int").alias("split"), role.alias("role"))


# -- margins of linear support vector machines ---------------------------------------


def _term_index(features: DataFrame, roles: DataFrame) -> DataFrame:
    """(family, problem, term, place): numbers of the known terms of each family and problem, from
    1; place 0 is the bias. Numbering runs in hashed buckets, not in one task per problem."""
    trained = roles.where("role <> 'test'").select(*DOC).distinct()
    terms = features.join(trained, DOC, "left_semi").select(*FAMILY, "term").distinct()
    return ordinal(terms, FAMILY, "term", "_r").select(*FAMILY, "term", (F.col("_r") + 1).alias("place"))


def block_rows(features: DataFrame, labels: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (family, problem, doc_name, slot, cases, places, values), one per family and document, and
    the sizes (family, problem, size) of the blocks.

    ``cases`` lists the (split, role) of the document. Documents without a known term keep their bias.
    """
    index = materialize(_term_index(features, roles))
    sizes = materialize(index.groupBy(*FAMILY).agg((F.count("*") + 1).alias("size")))
    numbered = join_dimension(features, index, [*FAMILY, "term"], DOC, materialized=True)
    cells = numbered.groupBy(*FAMILY, "doc_name").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_cells")
    )
    cases = roles.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("split", "role"))).alias("cases"))
    joined = join_dimension(cases, sizes.drop("size"), ["problem"], ["doc_name"], materialized=True).join(
        cells, [*FAMILY, "doc_name"], "left"
    ).join(labels, DOC, "left")
    places = F.coalesce(F.col("_cells.place"), F.array().cast("array<bigint>"))
    values = F.coalesce(F.col("_cells.value"), F.array().cast("array<double>"))
    return joined.select(
        *FAMILY, "doc_name", "slot", "cases",
        F.concat(F.array(F.lit(0).cast("bigint")), places).alias("places"),
        F.concat(F.array(F.lit(1.0)), values).alias("values"),
    ), sizes


def candidate_slots(known: DataFrame) -> DataFrame:
    """(problem, author, slot): position of a candidate in its problem's sorted list."""
    authors = known.select("problem", "author").distinct()
    order = Window.partitionBy("problem").orderBy("author")
    return authors.withColumn("slot", F.row_number().over(order) - 1)


def svm_margins(features: DataFrame, known: DataFrame, roles: DataFrame, c: float = 1.0,
                max_iter: int = SVM_ITERATIONS) -> DataFrame:
    """(family, problem, doc_name, split, role, author, margin, hit) of one-vs-rest linear SVMs.

    Squared hinge loss, penalised bias, classes balanced inside each binary task. Needs two candidates
    with training documents; a problem without them gets no rows. Problems of bounded size are solved in
    the dual where their documents are; problems with more documents by passes, unless their vocabulary
    is too large for that: those go to the dual too, in rounds. All ways reach the same minimum.
    """
    return linear_margins(features, known, roles, (dual.Setting("", c),), max_iter, SOLVED_GAP, None).drop("setting")


def linear_margins(features: DataFrame, known: DataFrame, roles: DataFrame, settings: Sequence[dual.Setting],
                   max_iter: int, gap: float, passes_gap: float | None) -> DataFrame:
    """``svm_margins`` of several costs and losses, with the column ``setting``; ``passes_gap``: the duality gap at which
    passes end, without it the tolerance of their gradients."""
    large = known.groupBy("problem").agg(F.count("*").alias("n")).where(F.col("n") > IN_PLACE_DOCS).select("problem")
    if large.isEmpty():
        return dual.margins(features, known, roles, settings, gap=gap)
    large = materialize(large)
    split = lambda df, how: join_dimension(df, large, ["problem"], ["doc_name"], how, materialized=True)
    rest = [df.join(F.broadcast(large), "problem", "left_anti") for df in (features, known, roles)]
    mine = [split(df, "left_semi") for df in (features, known, roles)]
    return reduce(DataFrame.unionByName, side_by_side([  # passes are short jobs one after the other, blocks few long tasks
        lambda: _margins_by_passes(*mine, settings, max_iter, gap, passes_gap),
        lambda: dual.margins(*rest, settings, gap=gap)]))


def _margins_by_passes(features: DataFrame, known: DataFrame, roles: DataFrame, settings: Sequence[dual.Setting],
                       max_iter: int, gap: float, passes_gap: float | None) -> DataFrame:
    """Margins of problems with many documents: rows stay spread, coefficients are held together."""
    slots = materialize(candidate_slots(known))
    labels = known.select(*PAIR).join(slots, ["problem", "author"]).select(*DOC, "slot")
    rows, sizes = block_rows(features, labels, roles)
    # Documents of a block stand together, so that a piece of rows belongs to one block.
    rows = materialize(rows.repartitionByRange(*FAMILY, "doc_name").sortWithinPartitions(*FAMILY, "doc_name"))
    trained = roles.where("role = 'train'").join(labels, DOC).groupBy("problem", "split", "slot").agg(
        F.count("*").alias("n_hit"))
    total = F.sum("n_hit").over(Window.partitionBy("problem", "split"))
    tasks = trained.withColumn("n_all", total).where("n_hit < n_all").groupBy("problem").agg(
        F.array_sort(F.collect_list(F.struct("split", "slot", "n_hit", "n_all"))).alias("tasks"))
    # One row per family and problem: its size and its tasks (splits x candidates).
    found = sizes.join(tasks, "problem").orderBy(*FAMILY).collect()
    wide = [(row["family"], row["problem"]) for row in found if row["size"] > svm.MAX_TERMS]
    found = [row for row in found if row["size"] <= svm.MAX_TERMS]
    apart = []
    if wide:
        own = F.broadcast(features.sparkSession.createDataFrame(wide, "family string, problem string"))
        mine = [df.join(own.select("problem").distinct(), "problem", "left_semi") for df in (known, roles)]
        apart = [dual.margins(features.join(own, FAMILY, "left_semi"), *mine, settings, gap=gap)]
    numbers = margins_numbers(features, found)
    rows = join_dimension(rows, numbers, FAMILY, ["doc_name"])
    in_training = F.transform(F.filter("cases", lambda x: x["role"] == "train"), lambda x: x["split"])
    n_splits = max((t["split"] + 1 for row in found for t in row["tasks"]), default=1)
    pieces = materialize(svm.pack_rows(rows.withColumn("train", in_training), n_splits))
    scored = rows.select(
        "block", F.col("doc_name").alias("id"), "slot", "places", "values",
        F.filter("cases", lambda x: x["role"] != "train").alias("cases")).where(F.size("cases") > 0)
    done, cells = [], svm.block_cells(pieces)
    for packed in fit_groups(found, settings, passes_gap):
        svm.solve(pieces, packed, max_iter, cells)
        done.append(materialize(svm.margins(scored, packed)))
        for block in packed:
            del block.state
    if not done:
        if apart:
            return apart[0]
        raise ValueError("no problem has two candidates with known documents")
    named = join_dimension(reduce(DataFrame.unionByName, done), numbers, ["block"], ["id"]).withColumnRenamed(
        "id", "doc_name")
    authors = join_dimension(
        named, slots.withColumnRenamed("slot", "task"), ["problem", "task"], ["doc_name"], materialized=True)
    columns = [*FAMILY, "setting", "doc_name", "split", "role", "author", "margin", "hit"]
    return reduce(DataFrame.unionByName, [materialize(authors.select(*columns)), *apart])


def margins_numbers(features: DataFrame, found: Sequence) -> DataFrame:
    """(family, problem, block): a number for every block that has tasks."""
    return features.sparkSession.createDataFrame(
        [(row["family"], row["problem"], k) for k, row in enumerate(found)],
        "family string, problem string, block int",
    )


def fit_groups(found: Sequence, settings: Sequence[dual.Setting] = (dual.Setting(),), gap: float | None = None) -> Iterator[list[svm.Block]]:
    """Tasks whose coefficients are held together, at most ``svm.MAX_COEFFICIENTS`` or one task."""
    packed, room = [], svm.MAX_COEFFICIENTS
    for number, row in enumerate(found):
        if row["size"] > svm.MAX_TERMS:
            raise ValueError(f"{row['size']} terms in {row['family']}, {row['problem']}: select fewer")
        left = [(t, s) for s in settings for t in row["tasks"]]
        while left:
            take = room // row["size"]
            if take < 1 and packed or packed and packed[-1].number == number:
                yield packed
                packed, room = [], svm.MAX_COEFFICIENTS
                continue
            now, left = left[:max(1, take)], left[max(1, take):]
            hits, total = (np.array([t[n] for t, _ in now], dtype=float) for n in ("n_hit", "n_all"))
            cost, same = np.array([s.cost for _, s in now]), np.array([s.balanced for _, s in now])
            packed.append(svm.Block(
                number, row["size"], np.array([t["split"] for t, _ in now]), np.array([t["slot"] for t, _ in now]),
                cost * np.where(same, total / (2 * hits), 1.0), cost * np.where(same, total / (2 * (total - hits)), 1.0),
                cost, np.array([s.loss == dual.HINGE for _, s in now]), np.array([s.name for _, s in now], dtype=object), gap))
            room -= row["size"] * len(now)
    if packed:
        yield packed


def svm_ovr(features: DataFrame, known: DataFrame, unknown: DataFrame, c: float = 1.0,
            max_iter: int = SVM_ITERATIONS) -> DataFrame:
    """(family, problem, doc_name, author, margin) for the unknown documents."""
    margins = svm_margins(features, known, plain_roles(known, unknown), c, max_iter)
    return margins.select(*FAMILY, "doc_name", "author", "margin")


# -- calibration ------------------------------------------------------------------------


def _sigmoid(margin: np.ndarray, hit: np.ndarray, max_iter: int) -> tuple[float, float]:
    """Slope and offset of one group by damped Newton steps."""
    pos, neg = hit.sum(), len(hit) - hit.sum()
    target = np.where(hit > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b, loss, da, db = 0.0, 0.0, np.inf, 0.0, np.log((pos + 1) / (neg + 1))
    for _ in range(max_iter):
        f = (a + da) * margin + b + db
        now = (np.maximum(f, 0) + np.log1p(np.exp(-np.abs(f))) - target * f).sum()
        if now <= loss:
            a, b, loss = a + da, b + db, now
            q = 1 / (1 + np.exp(-f))
            e, w = q - target, q * (1 - q)
            ga, gb = (e * margin).sum(), e.sum()
            haa, hab, hbb = (w * margin * margin).sum() + 1e-12, (w * margin).sum(), w.sum() + 1e-12
            det = haa * hbb - hab * hab
            da, db = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
        else:
            da, db = da / 2, db / 2
        if abs(da) + abs(db) <= 1e-8 * (1 + abs(a) + abs(b)):
            break
    return a, b


def platt_scale(margins: DataFrame, max_iter: int = 100) -> DataFrame:
    """(family, problem, author, split, slope, offset): p = 1 / (1 + exp(-(slope*margin + offset))).

    Targets are (n+ + 1)/(n+ + 2) and 1/(n- + 2). Every (family, problem, author, split) is fitted by
    itself: in one task if its margins are few, else by grouped sums. Both take the same damped Newton steps.
    """
    key = [*FAMILY, "author", "split"]
    training = margins.where("role = 'calibrate'").select(*key, "doc_name", "margin", "hit")
    counts = training.groupBy(*key).agg(F.count("*").alias("n"))
    large = materialize(counts.where(F.col("n") > IN_PLACE_MARGINS).select(*key))
    schema = "family string, problem string, author string, split int, slope double, offset double"
    form = margins.sparkSession.createDataFrame([], schema).toArrow().schema

    def fit(table: pa.Table) -> pa.Table:
        a, b = _sigmoid(np.asarray(table["margin"]), np.asarray(table["hit"]), max_iter)
        return pa.Table.from_pylist([table.slice(0, 1).select(key).to_pylist()[0] | {"slope": a, "offset": b}], schema=form)

    if large.isEmpty():
        return training.groupBy(*key).applyInArrow(fit, schema)
    few = join_dimension(training, large, key, ["doc_name"], "left_anti", materialized=True)
    many = join_dimension(training, large, key, ["doc_name"], "left_semi", materialized=True)
    return few.groupBy(*key).applyInArrow(fit, schema).unionByName(_sigmoids_by_sums(many, key, max_iter))


def _sigmoids_by_sums(training: DataFrame, key: list[str], max_iter: int) -> DataFrame:
    """Sigmoids of large groups: a step is six grouped sums, so neither margins nor sigmoids are
    gathered. A group whose loss rises goes half the way back."""
    counts = training.groupBy(*key).agg(
        F.sum("hit").alias("pos"), (F.count("*") - F.sum("hit")).alias("neg")
    )
    zero = F.lit(0.0)
    # a, b: best point with its loss; da, db: the step tried from there
    state = materialize(counts.select(
        *key, "pos", "neg", zero.alias("a"), zero.alias("b"), F.lit(float("inf")).alias("loss"), zero.alias("da"),
        F.log((F.col("pos") + 1) / (F.col("neg") + 1)).alias("db"),
    ))
    for _ in range(max_iter):
        joined = join_dimension(training, state, key, ["doc_name"], materialized=True)
        target = F.when(F.col("hit") > 0, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(
            F.lit(1.0) / (F.col("neg") + 2)
        )
        f = (F.col("a") + F.col("da")) * F.col("margin") + F.col("b") + F.col("db")
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-f))
        sums = joined.withColumn("f", f).withColumn("e", q - target).withColumn("w", q * (F.lit(1.0) - q)).withColumn(
            "l", F.greatest("f", zero) + F.log1p(F.exp(-F.abs("f"))) - target * F.col("f")
        ).groupBy(*state.columns).agg(  # the state goes along with its key
            F.sum("l").alias("now"), F.sum(F.col("e") * F.col("margin")).alias("ga"), F.sum("e").alias("gb"),
            (F.sum(F.col("w") * F.col("margin") * F.col("margin")) + 1e-12).alias("haa"),
            F.sum(F.col("w") * F.col("margin")).alias("hab"), (F.sum("w") + 1e-12).alias("hbb"),
        )
        better = F.col("now") <= F.col("loss")
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        step_a = (F.col("hab") * F.col("gb") - F.col("hbb") * F.col("ga")) / det
        step_b = (F.col("hab") * F.col("ga") - F.col("haa") * F.col("gb")) / det
        state = materialize(sums.select(
            *key, "pos", "neg",
            F.when(better, F.col("a") + F.col("da")).otherwise(F.col("a")).alias("a"),
            F.when(better, F.col("b") + F.col("db")).otherwise(F.col("b")).alias("b"),
            F.least("now", "loss").alias("loss"),
            F.when(better, step_a).otherwise(F.col("da") / 2).alias("da"),
            F.when(better, step_b).otherwise(F.col("db") / 2).alias("db"),
        ))
        far = F.abs("da") + F.abs("db") > 1e-8 * (1 + F.abs("a") + F.abs("b"))
        if state.where(far).isEmpty():
            break
    return state.select(*key, F.col("a").alias("slope"), F.col("b").alias("offset"))


def calibrated_scores(margins: DataFrame) -> DataFrame:
    """(problem, doc_name, model, author, p): calibrated, normed per document and split, then
    averaged over the document's splits; a candidate that a split doesn't know has 0 there."""
    sigmoids = platt_scale(margins)
    tests = margins.where("role = 'test'")
    joined = join_dimension(tests, sigmoids, [*FAMILY, "author", "split"], ["doc_name"])
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * F.col("margin") + F.col("offset"))))
    case = Window.partitionBy(*FAMILY, "doc_name", "split")
    total, count = F.sum("_q").over(case), F.count("*").over(case)
    normed = joined.withColumn("_q", raw).withColumn(
        "_p", F.when(total > 0, F.col("_q") / total).otherwise(F.lit(1.0) / count)
    )
    splits = F.size(F.collect_set("split").over(Window.partitionBy(*FAMILY, "doc_name")))
    return normed.withColumn("_splits", splits).groupBy(*DOC, F.col("family").alias("model"), "author").agg(
        (F.sum("_p") / F.first("_splits")).alias("p"))


def multi_fit_predict(features: DataFrame, known: DataFrame, unknown: DataFrame, folds: int = 3,
                      c: float = 1.0, max_iter: int = SVM_ITERATIONS) -> DataFrame:
    """Scores of one calibrated classifier per feature family for the unknown documents."""
    roles = materialize(calibration_roles(known, unknown, folds))
    return calibrated_scores(svm_margins(features, known, roles, c, max_iter))


def kernel_fit_predict(features: DataFrame, known: DataFrame, unknown: DataFrame, folds: int = 3,
                       c: float = 1.0, gamma: float | None = None) -> DataFrame:
    """Scores of calibrated one-vs-rest machines with radial kernel and hinge loss."""
    roles = materialize(calibration_roles(known, unknown, folds))
    settings = (dual.Setting("", c, dual.HINGE, balanced=False),)
    margins = dual.margins(features, known, roles, settings, radial=True, gamma=gamma, gap=KERNEL_GAP)
    return calibrated_scores(margins.drop("setting"))


def single_fit_predict(features: DataFrame, known: DataFrame, unknown: DataFrame, family: str,
                       **settings) -> DataFrame:
    return multi_fit_predict(features.where(F.col("family") == family), known, unknown, **settings)


def oof_predict(features: DataFrame, known: DataFrame, outer: int = 7, inner: int = 3,
                c: float = 1.0, max_iter: int = SVM_ITERATIONS) -> DataFrame:
    """Out-of-fold scores of the known documents."""
    roles = materialize(oof_roles(known, outer, inner))
    return calibrated_scores(svm_margins(features, known, roles, c, max_iter))


def _multinomial(x: np.ndarray, label: np.ndarray, classes: int, reg: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) that minimise the mean log loss plus reg / 2 times the squared weights of
    features divided by their standard deviation; constant features have no weight."""
    n, size = x.shape
    spread = x.std(axis=0, ddof=1) if n > 1 else np.zeros(size)
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)
    z = np.column_stack([x * scale, np.ones(n)])
    hit = np.zeros((n, classes))
    hit[np.arange(n), label] = 1.0
    free = np.ones(size + 1)
    free[-1] = 0.0  # the offset isn't penalised
    state = svm.Descent((size + 1) * classes, 1)
    for _ in range(max_iter):
        w = state.trial[:, 0].reshape(size + 1, classes)
        f = z @ w
        top = f.max(axis=1, keepdims=True)
        odds = np.exp(f - top)
        total = odds.sum(axis=1, keepdims=True)
        loss = (np.log(total[:, 0]) + top[:, 0] - (f * hit).sum(axis=1)).mean() + reg / 2 * (free[:, None] * w * w).sum()
        grad = z.T @ (odds / total - hit) / n + reg * free[:, None] * w
        state.tell(np.array([loss]), grad.reshape(-1, 1))
        if state.done.all():
            break
    w = state.point[:, 0].reshape(size + 1, classes)
    return w[:-1] * scale[:, None], w[-1]


def stacking(train_scores: DataFrame, test_scores: DataFrame, known: DataFrame,
             max_iter: int = STACK_ITERATIONS, reg: float = 0.01) -> DataFrame:
    """Second-level model on first-level scores: per problem a multinomial regression over its own
    (model, candidate) features and its own candidates, so that problems don't touch each other.

    Problems of bounded size are solved in a task each, all in one plan; a problem with more scores is
    fitted by passes over its rows. Both minimise the same loss.
    """
    slots = materialize(candidate_slots(known))
    places = train_scores.select("problem", "model").distinct().join(slots, "problem")
    numbered = materialize(places.withColumn(
        "g", F.row_number().over(Window.partitionBy("problem").orderBy("model", "slot")) - 1))

    def cells(scores: DataFrame) -> DataFrame:
        joined = join_dimension(
            scores, numbered, ["problem", "model", "author"], ["doc_name"], materialized=True
        )
        gathered = F.array_sort(F.collect_list(F.struct("g", "p")))
        return materialize(joined.groupBy(*DOC).agg(gathered.alias("c")))

    labels = materialize(known.select(*PAIR).join(slots, ["problem", "author"]).select(*DOC, "slot"))
    train, test = cells(train_scores).join(labels, DOC), cells(test_scores)
    sizes = materialize(train.groupBy("problem").agg(
        F.sum(F.size("c")).alias("cells"), (F.max("slot") + 1).alias("classes")).join(
        numbered.groupBy("problem").agg(F.count("*").alias("size")), "problem"))
    few = sizes.where(F.col("cells") <= STACK_CELLS)
    spread = _stacked_in_tasks(train, test, few, max_iter, reg)
    large = sizes.where(F.col("cells") > STACK_CELLS).orderBy("problem").collect()
    for row in large:  # each holds over STACK_CELLS scores
        own = F.col("problem") == row["problem"]
        vector = sparse_vector(row["size"], F.col("c.g"), F.col("c.p")).alias("features")
        model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial", tol=1e-9).fit(
            train.where(own).select(vector, F.col("slot").cast("double").alias("label")))
        spread = spread.unionByName(model.transform(test.where(own).select(*DOC, vector)).select(
            *DOC, F.posexplode(vector_to_array("probability")).alias("slot", "q")))
    named = join_dimension(spread, slots, ["problem", "slot"], ["doc_name"], materialized=True)
    total = F.sum("q").over(Window.partitionBy(*DOC))
    return named.select(*PAIR, (F.col("q") / total).alias("p"))


def _stacked_in_tasks(train: DataFrame, test: DataFrame, sizes: DataFrame, max_iter: int, reg: float) -> DataFrame:
    """(problem, doc_name, slot, q): a task fits one problem's regression; its documents are scored in pieces."""
    model_form = "problem string, weights binary, offsets binary, size int, classes int"
    score_form = "problem string, doc_name string, slot int, q double"
    forms = [train.sparkSession.createDataFrame([], f).toArrow().schema for f in (model_form, score_form)]

    def matrix(rows: list[dict], size: int) -> np.ndarray:
        x = np.zeros((len(rows), size))
        for i, row in enumerate(rows):
            x[i, [c["g"] for c in row["c"]]] = [c["p"] for c in row["c"]]
        return x

    def fit(table: pa.Table) -> pa.Table:
        rows = table.sort_by("doc_name").to_pylist()
        size, classes = rows[0]["size"], rows[0]["classes"]
        weights, offsets = _multinomial(
            matrix(rows, size), np.array([r["slot"] for r in rows]), classes, reg, max_iter)
        return pa.Table.from_pylist([{
            "problem": rows[0]["problem"], "weights": weights.tobytes(), "offsets": offsets.tobytes(), "size": size, "classes": classes,
        }], schema=forms[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for problem in dict.fromkeys(r["problem"] for r in rows):
                own = [r for r in rows if r["problem"] == problem]
                size, classes = own[0]["size"], own[0]["classes"]
                f = matrix(own, size) @ np.frombuffer(own[0]["weights"]).reshape(size, classes) + np.frombuffer(own[0]["offsets"])
                q = np.exp(f - f.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([problem] * q.size, pa.string()), pa.array([r["doc_name"] for r in own for _ in range(classes)], pa.string()),
                    pa.array(np.tile(np.arange(classes, dtype=np.int32), len(own))), pa.array(q.reshape(-1)),
                ], schema=forms[1])

    models = materialize(train.join(sizes, "problem").select(
        "problem", "doc_name", "c", "slot", F.col("size").cast("int").alias("size"), F.col("classes").cast("int").alias("classes"),
    ).groupBy("problem").applyInArrow(fit, model_form))
    return test.join(models, "problem").mapInArrow(score, score_form)


# -- classifiers on small dense vectors --------------------------------------------------


def term_vectors(features: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """Rows (problem, doc_name, features) over all terms of the known documents of one problem, and
    their number."""
    one_problem(known)
    terms = features.join(known.select(*DOC), DOC, "left_semi").select("problem", "term").distinct()
    index = materialize(ordinal(terms, ["problem"], "term", "i"))
    size = index.count()
    kept = join_dimension(features, index, ["problem", "term"], DOC, materialized=True)
    cells = F.array_sort(F.collect_list(F.struct("i", "value")))
    rows = kept.groupBy(*DOC).agg(cells.alias("c"))
    return rows.select(*DOC, sparse_vector(size, F.col("c.i"), F.col("c.value")).alias("features")), size


def one_problem(df: DataFrame) -> None:
    """Refuse more than one problem: place i and label k mean other things in each."""
    if df.select("problem").distinct().limit(2).count() > 1:
        raise ValueError("one problem at a time")


def fit_predict(estimator: Estimator, vectors: DataFrame, known: DataFrame, unknown: DataFrame,
                name: str) -> DataFrame:
    """Scores of any probabilistic classifier, fitted on the documents of one problem."""
    one_problem(known)
    slots = candidate_slots(known)
    labels = known.select(*PAIR).join(slots, ["problem", "author"])
    cases = vectors.join(labels, DOC).withColumn("label", F.col("slot").cast("double"))
    scored = estimator.fit(cases).transform(vectors.join(unknown.select(*DOC), DOC, "left_semi"))
    if "probability" in scored.columns:
        weights = vector_to_array("probability")
    else:  # one-vs-rest gives a margin per class: turn margins into shares
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m)))
        weights = odds
    spread = scored.select(*DOC, F.posexplode(weights).alias("slot", "q"))
    total = F.sum("q").over(Window.partitionBy(*DOC))
    named = join_dimension(spread, slots, ["problem", "slot"], ["doc_name"])
    return named.select(*DOC, F.lit(name).alias("model"), "author", (F.col("q") / total).alias("p"))


def mlp(k: int, classes: int, hidden: int = 100, max_iter: int = 200, seed: int = 1) -> Estimator:
    return MultilayerPerceptronClassifier(layers=[k, hidden, classes], maxIter=max_iter, seed=seed)


def random_forest(trees: int = 500, min_split: int = 50, seed: int = 1) -> Estimator:
    """A node splits from ``min_split`` rows on; the library bounds the children instead."""
    return RandomForestClassifier(numTrees=trees, minInstancesPerNode=min_split // 2, seed=seed)


def boosted(rounds: int = 50, seed: int = 1) -> Estimator:
    """One classifier per class; all of them run side by side."""
    return Boosted(classifier=GBTClassifier(maxIter=rounds, seed=seed), parallelism=8)


def param_grid(features: DataFrame, known: DataFrame, costs: Sequence[float] = COSTS,
               folds: int = GRID_FOLDS, losses: Sequence[str] = (dual.SQUARED,)) -> DataFrame:
    """(problem, family, cost, loss, f1, best): macro F1 of one-vs-rest linear SVMs per cost and loss, each
    document judged by the split that has not seen it; ``best`` marks the largest, of equal ones the
    smallest cost, then the first loss. All settings of a block share its kernel matrix or, with more documents, its passes."""
    pairs = fold_numbers(known, folds).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("fold") == F.col("split"), "test").otherwise("train")
    roles = materialize(pairs.select(*DOC, F.col("split").cast("int").alias("split"), role.alias("role")))
    gold = known.select(*PAIR).withColumnRenamed("author", "gold")
    grid = {f"{i:03}": (float(c), loss) for i, (c, loss) in enumerate((c, loss) for c in sorted(costs) for loss in losses)}
    settings = [dual.Setting(name, c, loss) for name, (c, loss) in grid.items()]
    chosen = linear_margins(features, known, roles, settings, GRID_PASSES, GRID_GAP, GRID_GAP).groupBy(*FAMILY, "setting", "doc_name").agg(
        F.min(F.struct((-F.col("margin")).alias("m"), F.col("author").alias("silver"))).alias("best"))
    # a family and setting is a problem of its own for the report
    answers = chosen.join(gold, DOC).select(
        F.struct("problem", "family", "setting").alias("problem"), "doc_name", "gold", F.col("best.silver").alias("silver"))
    scored = class_report(answers).groupBy("problem").agg(F.avg("f1").alias("f1")).select("problem.*", "f1")
    order = Window.partitionBy("problem", "family").orderBy(F.desc("f1"), F.asc("setting"))
    names = features.sparkSession.createDataFrame(
        [(name, c, loss) for name, (c, loss) in grid.items()], "setting string, cost double, loss string")
    return scored.withColumn("best", F.row_number().over(order) == 1).join(
        F.broadcast(names), "setting").select("problem", "family", "cost", "loss", "f1", "best")
