"""The feature recipe, and fitted models.

The numbers of a fitted model depend on its solver. Its queries return what must hold of them, and SQL
says for which documents, candidates and splits: which pairs are scored, that scores of a document sum to
one, that sigmoids have a flat loss, that answers are candidates, and that a separable target is learned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.operators import evaluate as E
from inkprint.operators import models as M
from inkprint.operators import svd
from inkprint.operators import vectorize as V
from inkprint.plans import ensemble
from inkprint.queries import corpus as C
from inkprint.queries.decisions import rounded
from inkprint.queries.derived import STEM_SQL, TAGS_SQL, stems, tags
from inkprint.queries.features import PROFILE_KEYS, PROFILES_SQL, USED_SQL, used
from inkprint.queries.texts import MASK_SQL, ORDINAL_SQL
from inkprint.session import materialize

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}


def _features(d, family="char2", low=2, high=2):
    fitted = V.fit_tfidf(C.known(d), V.chars(low, high), 0.12).transform(d)
    return materialize(fitted.withColumn("family", F.lit(family)))


def _parts(spark, sf):
    d = used(spark, sf)
    return d, C.known(d), C.unknown(d)


def _shares(scores, *keys):
    """Per document: its candidates, whether all shares are in order and sum to one."""
    fine = F.bool_and((F.col("p") >= 0) & (F.col("p") <= 1))
    return scores.groupBy(*keys).agg(
        F.countDistinct("author").alias("n_authors"), F.count("*").alias("n_scores"), fine.alias("in_range"),
        F.round(F.sum("p"), 6).alias("sum_p"))


def _shares_sql(source, models=("",), alias="problem, doc_name"):
    """Every document of ``source`` with all candidates of its problem, for each model."""
    rows = ", ".join(f"('{m}')" for m in models)
    model = "" if models == ("",) else ", model"
    return C.sql(
        "candidates AS (SELECT DISTINCT problem, author FROM known)", f"""
SELECT {alias}{model}, count(*) AS n_authors, count(*) AS n_scores, true AS in_range, 1.0::DOUBLE AS sum_p
FROM {source} s JOIN candidates c USING (problem), (VALUES {rows}) AS m(model) GROUP BY ALL""")


def svm_ovr(spark, sf):
    d, known, unknown = _parts(spark, sf)
    margins = M.svm_ovr(_features(d), known, unknown)
    number = ~F.isnan("margin") & (F.abs("margin") < float("inf"))
    return margins.groupBy("problem", "doc_name").agg(
        F.countDistinct("author").alias("n_authors"), F.count("*").alias("n_margins"), F.bool_and(number).alias("finite"))


ORACLES["svm_ovr"] = C.sql("candidates AS (SELECT DISTINCT problem, author FROM known)", """
SELECT problem, doc_name, count(*) AS n_authors, count(*) AS n_margins, true AS finite
FROM unknown JOIN candidates c USING (problem) GROUP BY ALL""")


def calibrate_sigmoid(spark, sf):
    """Both sums that are zero where the loss of a sigmoid is least, per candidate and split."""
    d, known, unknown = _parts(spark, sf)
    roles = materialize(M.calibration_roles(known, unknown))
    margins = M.svm_margins(_features(d), known, roles).where("role = 'calibrate'")
    keys = ["family", "problem", "author", "split"]
    fitted = margins.join(M.platt_scale(margins), keys)
    counts = fitted.groupBy(*keys).agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * F.col("margin") + F.col("offset"))))
    target = F.when(F.col("hit") > 0, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(1 / (F.col("neg") + 2))
    sums = fitted.join(counts, keys).withColumn("e", p - target).groupBy("problem", "author", "split").agg(
        F.count("*").alias("n_docs"), F.sum("e").alias("a"), F.sum(F.col("e") * F.col("margin")).alias("b"))
    return sums.select("problem", "author", "split", "n_docs", ((F.abs("a") < 1e-4) & (F.abs("b") < 1e-4)).alias("flat"))


ORACLES["calibrate_sigmoid"] = C.sql(
    f"""folds AS (
  SELECT problem, doc_name, (row_number() OVER (PARTITION BY problem, author ORDER BY {ORDINAL_SQL}) - 1) % 3 AS fold
  FROM known)""", """
SELECT problem, author, fold::INT AS split, n_docs, true AS flat
FROM (SELECT problem, fold, count(*) AS n_docs FROM folds GROUP BY ALL)
JOIN (SELECT *, count(*) FILTER (k > 1) OVER (PARTITION BY problem) AS many
      FROM (SELECT problem, author, count(*) AS k FROM known GROUP BY ALL)) USING (problem)
-- the only document of a candidate calibrates split 0 and leaves none to learn from; a task needs two candidates
WHERE fold > 0 OR k > 1 AND many > 1""")


def multi_fit_predict(spark, sf):
    d, known, unknown = _parts(spark, sf)
    features = _features(d).unionByName(_features(d, "char1", 1, 1))
    return _shares(M.multi_fit_predict(features, known, unknown), "problem", "doc_name", "model")


def single_fit_predict(spark, sf):
    d, known, unknown = _parts(spark, sf)
    return _shares(M.single_fit_predict(_features(d), known, unknown, "char2"), "problem", "doc_name")


def svm_baseline(spark, sf):
    """Whether every unknown document is answered once, by a candidate or by none."""
    _, known, unknown = _parts(spark, sf)
    answers = ensemble.attribute_by_counts(known, unknown)
    names = known.select("problem", F.col("author").alias("predicted_author"), F.lit(True).alias("named")).distinct()
    return answers.join(names, ["problem", "predicted_author"], "left").groupBy("problem", "doc_name").agg(
        F.count("*").alias("n_answers"),
        F.bool_and(F.coalesce("named", F.col("predicted_author") == C.UNKNOWN)).alias("allowed"))


ORACLES["multi_fit_predict"] = _shares_sql("unknown", ("char1", "char2"))
ORACLES["single_fit_predict"] = _shares_sql("unknown")
ORACLES["svm_baseline"] = C.sql("SELECT problem, doc_name, 1 AS n_answers, true AS allowed FROM unknown")


def _languages(d):
    return d.withColumn("language", F.coalesce(
        F.element_at(F.create_map(F.lit("en"), F.lit("english"), F.lit("es"), F.lit("spanish"),
                                  F.lit("fr"), F.lit("french")), F.col("problem")), F.col("problem")))


def feature_recipe(spark, sf):
    d = _languages(used(spark, sf))
    features = ensemble.feature_recipe(d, stems(d), tags(d))
    return features.groupBy("family", "problem").agg(
        F.count("*").alias("n_values"), F.round(F.sum("value"), 2).alias("sum_value"))


def _family_sql(name, counts, min_df, source="known"):
    """Weights of ``counts`` with a vocabulary fitted on its known documents."""
    return [
        f"{name}_train AS (SELECT g.* FROM {counts} g SEMI JOIN known USING (problem, doc_name))",
        C.idf_sql(f"{name}_idf", f"{name}_train", source, min_df),
        C.tfidf_sql(name, counts, f"{name}_idf"),
    ]


def _recipe_part(family, table):
    return f"SELECT '{family}' AS family, problem, value FROM {table}"


ORACLES["feature_recipe"] = C.sql(
    USED_SQL, PROFILES_SQL, STEM_SQL.format(source="used"), TAGS_SQL,
    C.char_counts_sql("char_g", "used", [3, 4, 5]), *_family_sql("char_v", "char_g", 0.12),
    C.word_counts_sql("word_g", "stemmed", 1, 3, C.DEFAULT_SQL), *_family_sql("word_v", "word_g", 0.03),
    f"masked AS (SELECT problem, doc_name, {MASK_SQL} AS text FROM used)",
    C.char_counts_sql("mask_en", "(SELECT * FROM masked WHERE problem = 'en')", [2, 3, 4, 5, 6]),
    C.char_counts_sql("mask_other", "(SELECT * FROM masked WHERE problem <> 'en')", list(range(1, 9))),
    "mask_g AS (SELECT * FROM mask_en UNION ALL SELECT * FROM mask_other)",
    *_family_sql("mask_v", "mask_g", 0.12),
    C.char_counts_sql("pc_g", "profiles", [3, 4, 5], keys=PROFILE_KEYS),
    C.idf_sql("pc_idf", "pc_g", "profiles", 0.12), C.tfidf_sql("pc_v", "char_g", "pc_idf"),
    C.word_counts_sql("pw_g", "profiles", 1, 3, keys=PROFILE_KEYS),
    C.idf_sql("pw_idf", "pw_g", "profiles", 0.03),
    C.word_counts_sql("stem_g", "stemmed", 1, 3), C.tfidf_sql("pw_v", "stem_g", "pw_idf"),
    C.word_counts_sql("w1_g", "(SELECT * FROM stemmed WHERE problem = 'en')", 1, 1, C.DEFAULT_SQL),
    *_family_sql("w1_v", "w1_g", 0.03),
    C.word_counts_sql("w2_g", "(SELECT * FROM stemmed WHERE problem = 'en')", 2, 2, C.DEFAULT_SQL),
    *_family_sql("w2_v", "w2_g", 0.03),
    """tagged AS (SELECT problem, doc_name, string_agg(tag, ' ' ORDER BY pos) AS text
  FROM tags SEMI JOIN used USING (problem, doc_name) WHERE problem IN ('en', 'es') GROUP BY ALL)""",
    C.char_counts_sql("tag_g", "tagged", [4, 5]), *_family_sql("tag_v", "tag_g", 0.12),
    "everything AS (" + " UNION ALL ".join(_recipe_part(f, t) for f, t in (
        ("char", "char_v"), ("word", "word_v"), ("masked", "mask_v"), ("profile", "pc_v"),
        ("profile", "pw_v"), ("word_pair", "w1_v"), ("word_pair", "w2_v"), ("tag", "tag_v"))) + ")",
    """SELECT family, problem, count(*) AS n_values, round(sum(value), 2) AS sum_value
FROM everything GROUP BY family, problem""")


def main_ensemble(spark, sf):
    d = _languages(used(spark, sf))
    answers, _ = ensemble.attribute(d, stems(d), tags(d))
    gold = C.unknown(d).select("problem", "doc_name", "true_author")
    return rounded(E.macro_prf(E.align(gold, answers)),
                   "macro_f1", "macro_precision", "macro_recall", digits=4)


def oof_predict(spark, sf):
    d, known, _ = _parts(spark, sf)
    return _shares(M.oof_predict(_features(d), known), "problem", "doc_name")


def stacking(spark, sf):
    d, known, unknown = _parts(spark, sf)
    features = _features(d)
    train = materialize(M.oof_predict(features, known))
    test = M.multi_fit_predict(features, known, unknown)
    return _shares(M.stacking(train, test, known), "problem", "doc_name").select("problem", "doc_name", "in_range", "sum_p")


#: Which candidates score a document: those that some split of its outer fold learns, where documents are left to calibrate.
OOF_SQL = [
    f"""folds AS (
  SELECT problem, doc_name, author,
         (row_number() OVER (PARTITION BY problem, author ORDER BY {ORDINAL_SQL}) - 1) % 21 AS f FROM known)""",
    "splits AS (SELECT o, i FROM range(7) AS a(o), range(3) AS b(i))",
    "learned AS (SELECT DISTINCT problem, o, i, author FROM folds, splits WHERE f // 3 <> o AND f % 3 <> i)",
    """usable AS (
  SELECT problem, o, i FROM learned GROUP BY ALL HAVING count(*) > 1
  INTERSECT SELECT problem, o, i FROM folds, splits WHERE f // 3 <> o AND f % 3 = i)""",
    """scored AS (
  SELECT DISTINCT d.problem, d.doc_name, t.author
  FROM folds d JOIN usable u ON u.problem = d.problem AND u.o = d.f // 3
  JOIN learned t ON t.problem = u.problem AND t.o = u.o AND t.i = u.i)""",
]
ORACLES["oof_predict"] = C.sql(*OOF_SQL, """
SELECT problem, doc_name, count(*) AS n_authors, count(*) AS n_scores, true AS in_range, 1.0::DOUBLE AS sum_p
FROM scored GROUP BY ALL""")
ORACLES["stacking"] = C.sql(*OOF_SQL, """
SELECT problem, doc_name, true AS in_range, 1.0::DOUBLE AS sum_p
FROM unknown SEMI JOIN scored USING (problem)""")


def _target(spark, sf):
    """A separable target for classifiers: the language of a document."""
    d = C.docs(spark, sf).withColumn("author", F.col("language")).withColumn(
        "problem", F.lit("language"))
    known = d.where("split = 'known'")
    return V.fit_tfidf(known, V.chars(1, 2), 0.12).transform(d), known, C.unknown(d)


def _one_problem(spark, sf):
    features, known, unknown = _target(spark, sf)
    vectors, size = M.term_vectors(features, known)
    return materialize(vectors), known, unknown, size


def _dense(estimator, name):
    """The separable target: documents scored, whether shares sum to one and nine in ten are right."""
    def run(spark, sf):
        vectors, known, unknown, size = _one_problem(spark, sf)
        scores = materialize(M.fit_predict(estimator(size), vectors, known, unknown, name))
        best = scores.groupBy("doc_name").agg(F.sum("p").alias("sum_p"), F.max_by("author", "p").alias("silver"))
        right = F.avg((F.col("silver") == F.col("author")).cast("double"))
        return best.join(unknown.select("doc_name", "author"), "doc_name").agg(
            F.count("*").alias("n_docs"), F.bool_and(F.abs(F.col("sum_p") - 1) < 1e-6).alias("shares"),
            (right >= 0.9).alias("learned"))

    return run


DENSE_SQL = C.sql("SELECT count(*) AS n_docs, true AS shares, true AS learned FROM unknown")


def param_grid(spark, sf):
    """Settings judged per problem, whether scores are in order, and how many are best."""
    d, known, _ = _parts(spark, sf)
    return M.param_grid(_features(d), known, losses=M.LOSSES).groupBy("problem", "family").agg(
        F.count("*").alias("n_settings"), F.bool_and((F.col("f1") >= 0) & (F.col("f1") <= 1)).alias("in_range"),
        F.sum(F.col("best").cast("int")).alias("n_best"), (F.max("f1") == F.max(F.when(F.col("best"), F.col("f1")))).alias("largest"))


ORACLES["param_grid"] = C.sql(
    "SELECT DISTINCT problem, 'char2' AS family, 16 AS n_settings, true AS in_range, 1 AS n_best, true AS largest FROM known")


def svd_reduce(spark, sf):
    """Centred and not: documents on each component, and whether the known ones, whitened, have standard deviation 1,
    if centred mean 0, and components are uncorrelated there (centred)."""
    features, known, _ = _target(spark, sf)
    features, parts = materialize(features), []
    for center in (True, False):
        reduced = materialize(svd.svd_reduce(features, known, 5, center=center, whiten=True))
        mine = reduced.join(known.select("problem", "doc_name", F.lit(1).alias("is_known")), ["problem", "doc_name"], "left")
        inside = F.when(F.col("is_known") == 1, F.col("value"))
        parts.append(mine.groupBy("problem", "component").agg(
            F.count("*").alias("n_docs"), (F.abs(F.stddev_samp(inside) - 1) < 1e-6).alias("unit"),
            (F.abs(F.avg(inside)) < (1e-6 if center else float("inf"))).alias("in_middle"),
            F.bool_and((F.col("explained") >= 0) & (F.col("explained") <= 1)).alias("share"),
        ).withColumn("centred", F.lit(center)))
    return parts[0].unionByName(parts[1])


ORACLES["svd_reduce"] = C.sql("""
SELECT 'language' AS problem, c::INT AS component, centred, n_docs, true AS unit, true AS in_middle, true AS share
FROM range(5) AS r(c), (VALUES (true), (false)) AS m(centred), (
  SELECT count(*) AS n_docs FROM corpus WHERE text IS NOT NULL AND length(text) > 0)""")


for query in (svm_ovr, calibrate_sigmoid, multi_fit_predict, single_fit_predict, svm_baseline,
              feature_recipe, main_ensemble, oof_predict, stacking, param_grid, svd_reduce):
    QUERIES[query.__name__] = query
QUERIES["mlp"] = _dense(lambda size: M.mlp(size, 4), "mlp")
QUERIES["random_forest"] = _dense(lambda size: M.random_forest(), "random_forest")
QUERIES["boosted"] = _dense(lambda size: M.boosted(), "boosted")
ORACLES |= dict.fromkeys(("mlp", "random_forest", "boosted"), DENSE_SQL)
