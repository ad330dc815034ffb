"""Similarities, voting, reject rules and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.operators import decide as D
from inkprint.operators import evaluate as E
from inkprint.operators import similarity as S
from inkprint.operators import vectorize as V
from inkprint.plans.profile_similarity import attribute_by_profile
from inkprint.queries import corpus as C
from inkprint.queries.features import PROFILES_SQL, PROFILE_KEYS, USED_SQL, used
from inkprint.queries.texts import ORDINAL_SQL
from inkprint.session import materialize
from inkprint.sources import results as R

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}

PT = 0.002  # shares of similar profiles lie close together


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# -- similarity matrices -------------------------------------------------------------


def cosine_matrix(spark, sf):
    d = used(spark, sf)
    fitted = V.fit_profile_chars(C.known(d), 3, 3)
    cosines = S.cosine_matrix(fitted.transform(d), fitted.profiles())
    return rounded(S.complete_scores(d, C.candidates(d), cosines, "cosine"), "cosine")


PROFILE3_SQL = [
    USED_SQL, PROFILES_SQL, C.char_counts_sql("profile_grams", "profiles", [3], keys=PROFILE_KEYS),
    C.char_counts_sql("grams", "used", [3]), C.idf_sql("idf", "profile_grams", "profiles", 0.12),
    C.tfidf_sql("profile_weights", "profile_grams", "idf", key="author"),
    C.tfidf_sql("weights", "grams", "idf"),
    "candidates AS (SELECT DISTINCT problem, author FROM known)",
    """cosines AS (
  SELECT problem, doc_name, author, coalesce(c, 0) AS cosine
  FROM (SELECT problem, doc_name, c.author FROM used JOIN candidates c USING (problem))
  LEFT JOIN (SELECT problem, doc_name, author, sum(w.value * p.value) AS c
             FROM weights w JOIN profile_weights p USING (problem, term) GROUP BY ALL)
  USING (problem, doc_name, author))""",
]
QUERIES["cosine_matrix"] = cosine_matrix
ORACLES["cosine_matrix"] = C.sql(
    *PROFILE3_SQL, "SELECT problem, doc_name, author, round(cosine, 6) AS cosine FROM cosines")


def cosine_self(spark, sf):
    fitted = V.fit_profile_chars(C.known(C.docs(spark, sf)), 3, 3)
    return rounded(S.cosine_self(fitted.profiles()), "cosine")


QUERIES["cosine_self"] = cosine_self
ORACLES["cosine_self"] = C.sql(*PROFILE3_SQL, """
SELECT problem, a.author, b.author AS other, round(sum(a.value * b.value), 6) AS cosine
FROM profile_weights a JOIN profile_weights b USING (problem, term) GROUP BY ALL""")


# -- scores of two cheap models: cosine with the author centroid of 1-grams and of 2-grams ----


def _centroid_model(d, n):
    known = C.known(d)
    features = materialize(V.fit_tfidf(known, V.chars(n, n), 0.12).transform(d))
    centroids = S.author_centroids(features, known)
    return features, centroids


def centroid_scores(spark, sf, sizes=(1, 2)):
    """(problem, doc_name, model, author, cosine, p) for all used documents."""
    d = used(spark, sf)
    out = None
    for n in sizes:
        features, centroids = _centroid_model(d, n)
        cosines = S.complete_scores(
            d, C.candidates(d), S.cosine_matrix(features, centroids), "cosine")
        part = S.share_per_document(cosines, "cosine").withColumn("model", F.lit(f"c{n}"))
        part = rounded(part, "p", "cosine")
        out = part if out is None else out.unionByName(part)
    return materialize(out)


def _model_sql(n):
    return [
        C.char_counts_sql(f"grams{n}", "used", [n]),
        f"train{n} AS (SELECT g.* FROM grams{n} g SEMI JOIN known USING (problem, doc_name))",
        C.idf_sql(f"idf{n}", f"train{n}", "known", 0.12),
        C.tfidf_sql(f"weights{n}", f"grams{n}", f"idf{n}"),
        f"""centroids{n} AS (
  SELECT problem, author, term, sum(value) / any_value(n) AS value
  FROM weights{n} JOIN (SELECT problem, doc_name, author,
                               count(*) OVER (PARTITION BY problem, author) AS n FROM known)
       USING (problem, doc_name) GROUP BY problem, author, term)""",
        f"""scores{n} AS (
  SELECT problem, doc_name, 'c{n}' AS model, author, round(cosine, 6) AS cosine,
         round(CASE WHEN sum(cosine) OVER doc > 0 THEN cosine / sum(cosine) OVER doc ELSE 0 END, 6) AS p
  FROM (SELECT problem, doc_name, c.author, coalesce(dot / (na * nb), 0) AS cosine
        FROM (SELECT problem, doc_name, c.author FROM used JOIN candidates c USING (problem)) c
        LEFT JOIN (SELECT problem, doc_name, author, sum(w.value * m.value) AS dot
                   FROM weights{n} w JOIN centroids{n} m USING (problem, term) GROUP BY ALL)
          USING (problem, doc_name, author)
        LEFT JOIN (SELECT problem, doc_name, sqrt(sum(value * value)) AS na FROM weights{n} GROUP BY ALL)
          USING (problem, doc_name)
        LEFT JOIN (SELECT problem, author, sqrt(sum(value * value)) AS nb FROM centroids{n} GROUP BY ALL)
          USING (problem, author))
  WINDOW doc AS (PARTITION BY problem, doc_name))""",
    ]


CANDIDATES_SQL = "candidates AS (SELECT DISTINCT problem, author FROM known)"
TWO_MODELS_SQL = [
    USED_SQL, CANDIDATES_SQL, *_model_sql(1), *_model_sql(2),
    "scores AS (SELECT * FROM scores1 UNION ALL SELECT * FROM scores2)",
]
ONE_MODEL_SQL = [USED_SQL, CANDIDATES_SQL, *_model_sql(2), "scores AS (SELECT * FROM scores2)"]
TRUTH_SQL = "truth AS (SELECT problem, doc_name, true_author FROM used)"
TOP_SQL = """top AS (
  SELECT problem, doc_name, min(author) FILTER (r = 1) AS predicted_author,
         coalesce(max(p) FILTER (r = 1), 0) AS p1, coalesce(max(p) FILTER (r = 2), 0) AS p2,
         coalesce(max(p) FILTER (r = 3), 0) AS p3, coalesce(max(p) FILTER (r = 4), 0) AS p4,
         min(author) FILTER (r = 2) AS second
  FROM (SELECT *, row_number() OVER (PARTITION BY problem, doc_name ORDER BY p DESC, author) AS r
        FROM scores) GROUP BY ALL)"""


def truth(spark, sf):
    return used(spark, sf).select("problem", "doc_name", "true_author")


def author_centroids(spark, sf):
    _, centroids = _centroid_model(used(spark, sf), 2)
    return rounded(centroids, "value")


QUERIES["author_centroids"] = author_centroids
ORACLES["author_centroids"] = C.sql(
    *ONE_MODEL_SQL, "SELECT problem, author, term, round(value, 6) AS value FROM centroids2")


def minmax_distance(spark, sf):
    features, centroids = _centroid_model(used(spark, sf), 2)
    return rounded(S.minmax_distance(features, centroids), "distance")


QUERIES["minmax_distance"] = minmax_distance
ORACLES["minmax_distance"] = C.sql(*ONE_MODEL_SQL, """
SELECT problem, doc_name, author, round(1 - lo / (sa + sb - lo + 1e-6), 6) AS distance
FROM (SELECT problem, doc_name, author, sum(least(w.value, m.value)) AS lo
      FROM weights2 w JOIN centroids2 m USING (problem, term) GROUP BY ALL)
JOIN (SELECT problem, doc_name, sum(value) AS sa FROM weights2 GROUP BY ALL) USING (problem, doc_name)
JOIN (SELECT problem, author, sum(value) AS sb FROM centroids2 GROUP BY ALL) USING (problem, author)""")


def novelty(spark, sf):
    d = used(spark, sf)
    features = materialize(V.fit_tfidf(C.known(d), V.chars(2, 2), 0.12).transform(d))
    return S.novelty(features, C.known(d))


NOVELTY_SQL = [
    "center AS (SELECT problem, term, sum(value) / any_value(n) AS value FROM weights2 "
    "SEMI JOIN known USING (problem, doc_name) JOIN (SELECT problem, count(*) AS n FROM known GROUP BY ALL) "
    "USING (problem) GROUP BY problem, term)",
    """nearness AS (
  SELECT problem, doc_name, round(sum(w.value * c.value) / (sqrt(sum(w.value * w.value)) * any_value(nc)), 6) AS similarity
  FROM weights2 w JOIN center c USING (problem, term)
  JOIN (SELECT problem, sqrt(sum(value * value)) AS nc FROM center GROUP BY ALL) USING (problem)
  GROUP BY problem, doc_name)""",
    """novel AS (
  SELECT problem, doc_name, similarity, CASE WHEN similarity < cutoff THEN -1 ELSE 1 END AS novelty
  FROM nearness JOIN (SELECT problem, quantile_cont(similarity, 0.5) AS cutoff
                     FROM nearness SEMI JOIN known USING (problem, doc_name) GROUP BY ALL) USING (problem))""",
]
QUERIES["novelty"] = novelty
ORACLES["novelty"] = C.sql(*ONE_MODEL_SQL, *NOVELTY_SQL, "SELECT * FROM novel")


# -- votes ------------------------------------------------------------------------------


def soft_vote(spark, sf):
    voted = rounded(D.soft_vote(centroid_scores(spark, sf), {"c1": 0.75, "c2": 1.25}), "p", digits=7)
    return D.argmax_label(voted)


VOTE_SQL = """voted AS (
  SELECT problem, doc_name, author,
         round(sum(p * {weight}) / sum({weight}), 7) AS p FROM scores GROUP BY ALL)"""
BEST_SQL = """SELECT problem, doc_name, arg_min(author, struct_pack(q := -p, a := author)) AS predicted_author, max(p) AS p
FROM voted GROUP BY ALL"""
QUERIES["soft_vote"] = soft_vote
ORACLES["soft_vote"] = C.sql(
    *TWO_MODELS_SQL, VOTE_SQL.format(weight="(CASE model WHEN 'c1' THEN 0.75::DOUBLE ELSE 1.25::DOUBLE END)"),
    BEST_SQL)


def mean_two(spark, sf):
    scores = centroid_scores(spark, sf)
    parts = [scores.where(F.col("model") == m).drop("model") for m in ("c1", "c2")]
    return rounded(D.mean_two(*parts), "p", digits=7)


QUERIES["mean_two"] = mean_two
ORACLES["mean_two"] = C.sql(*TWO_MODELS_SQL, VOTE_SQL.format(weight="1.0::DOUBLE"), "SELECT * FROM voted")


def vote_classifier(spark, sf):
    return D.argmax_label(rounded(D.soft_vote(centroid_scores(spark, sf)), "p", digits=7))


QUERIES["vote_classifier"] = vote_classifier
ORACLES["vote_classifier"] = C.sql(*TWO_MODELS_SQL, VOTE_SQL.format(weight="1.0::DOUBLE"), BEST_SQL)


def pick_confident(spark, sf):
    return D.pick_confident(centroid_scores(spark, sf))


QUERIES["pick_confident"] = pick_confident
ORACLES["pick_confident"] = C.sql(*TWO_MODELS_SQL, """
SELECT problem, doc_name, model, predicted_author FROM (
  SELECT *, row_number() OVER (PARTITION BY problem, doc_name ORDER BY confidence DESC, model) AS r FROM (
    SELECT problem, doc_name, model, min(p) AS confidence,
           arg_min(author, struct_pack(q := -p, a := author)) AS predicted_author
    FROM scores GROUP BY ALL)) WHERE r = 1""")


def proba_compare(spark, sf):
    return rounded(D.proba_compare(centroid_scores(spark, sf)), "p", "total", digits=7)


QUERIES["proba_compare"] = proba_compare
ORACLES["proba_compare"] = C.sql(*TWO_MODELS_SQL, """
SELECT problem, doc_name, author, round(m, 7) AS p,
       round(sum(m) OVER (PARTITION BY problem, doc_name), 7) AS total
FROM (SELECT problem, doc_name, author, avg(p) AS m FROM scores GROUP BY ALL)""")


def proba_reverse(spark, sf):
    scores = centroid_scores(spark, sf, (2,)).select("problem", "doc_name", "author", "p")
    return rounded(D.proba_reverse(scores), "p")


QUERIES["proba_reverse"] = proba_reverse
ORACLES["proba_reverse"] = C.sql(
    *ONE_MODEL_SQL, "SELECT problem, doc_name, author, round(1 - p, 6) AS p FROM scores")


def argmax_label(spark, sf):
    return D.argmax_label(centroid_scores(spark, sf, (2,)))


QUERIES["argmax_label"] = argmax_label
ORACLES["argmax_label"] = C.sql(
    *ONE_MODEL_SQL, "voted AS (SELECT * FROM scores)", BEST_SQL)


# -- reject rules -------------------------------------------------------------------------


def _answers(df):
    return df.select("problem", "doc_name", "predicted_author")


def _reject_sql(condition, *more):
    return C.sql(*ONE_MODEL_SQL, TOP_SQL, *more, f"""
SELECT problem, doc_name, CASE WHEN {condition} THEN '<UNK>' ELSE predicted_author END AS predicted_author
FROM top{" " if not more else " LEFT JOIN extra USING (problem, doc_name)"}""")


GAP3_SQL = f"p1 - p2 < {PT} AND ((p1 - p2) + (p2 - p3)) / 2 < 0.0014"
QUERIES["reject_gap"] = lambda spark, sf: _answers(D.reject_gap(centroid_scores(spark, sf, (2,)), PT))
ORACLES["reject_gap"] = _reject_sql(f"p1 - p2 < {PT}")
QUERIES["reject_gap3"] = lambda spark, sf: _answers(
    D.reject_gap3(centroid_scores(spark, sf, (2,)), PT, 0.0014))
ORACLES["reject_gap3"] = _reject_sql(GAP3_SQL)


def reject_cosine(spark, sf):
    scores = centroid_scores(spark, sf)
    one = scores.where("model = 'c1'")
    return _answers(D.reject_cosine(scores.where("model = 'c2'"), one, PT + 0.01))


QUERIES["reject_cosine"] = reject_cosine
ORACLES["reject_cosine"] = _reject_sql(
    f"predicted_author <> chosen AND p1 - p2 < {PT} + 0.01 - 0.01", *_model_sql(1),
    """extra AS (SELECT problem, doc_name, arg_min(author, struct_pack(c := cosine, a := author)) AS chosen
  FROM scores1 GROUP BY ALL)""")


def reject_novelty(spark, sf):
    return _answers(D.reject_novelty(centroid_scores(spark, sf, (2,)), novelty(spark, sf), PT))


QUERIES["reject_novelty"] = reject_novelty
ORACLES["reject_novelty"] = _reject_sql(
    f"p1 - p2 < {PT} AND ((p1 - p2) + (p2 - p3)) / 2 < 0.1 AND coalesce(novelty, 1) < 0", *NOVELTY_SQL,
    "extra AS (SELECT problem, doc_name, novelty FROM novel)")


# -- evaluation -----------------------------------------------------------------------------


def _case(spark, sf):
    scores = centroid_scores(spark, sf, (2,))
    answers = materialize(_answers(D.reject_gap3(scores, PT, 0.0014)))
    return scores, answers, truth(spark, sf)


def _aligned(spark, sf):
    _, answers, gold = _case(spark, sf)
    return E.align(gold, answers)


ALIGNED_SQL = [
    *ONE_MODEL_SQL, TOP_SQL, TRUTH_SQL,
    f"""answers AS (SELECT problem, doc_name, CASE WHEN {GAP3_SQL} THEN '<UNK>' ELSE predicted_author END
  AS predicted_author FROM top)""",
    """aligned AS (
  SELECT problem, doc_name, true_author AS gold,
         CASE WHEN (problem, predicted_author) IN (SELECT (problem, true_author) FROM truth)
              THEN predicted_author ELSE '<UNK>' END AS silver
  FROM truth LEFT JOIN answers USING (problem, doc_name))""",
    """report AS (
  SELECT problem, gold AS author, coalesce(tp / answered, 0) AS precision, tp / support AS recall,
         CASE WHEN tp > 0 THEN 2 * tp / (answered + support) ELSE 0 END AS f1,
         CAST(support AS BIGINT) AS support
  FROM (SELECT problem, gold, count(*)::DOUBLE AS support, (count(*) FILTER (gold = silver))::DOUBLE AS tp
        FROM aligned GROUP BY ALL)
  LEFT JOIN (SELECT problem, silver AS gold, count(*)::DOUBLE AS answered FROM aligned GROUP BY ALL)
  USING (problem, gold))""",
    """macro AS (
  SELECT problem, avg(f1) AS macro_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall
  FROM report WHERE author <> '<UNK>' GROUP BY problem)""",
]


def _register(name, run, body):
    QUERIES[name] = run
    ORACLES[name] = C.sql(*ALIGNED_SQL, body)


MACRO_COLUMNS = ("macro_f1", "macro_precision", "macro_recall")
_register("macro_prf", lambda s, sf: rounded(E.macro_prf(_aligned(s, sf)), *MACRO_COLUMNS), """
SELECT problem, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision,
       round(macro_recall, 6) AS macro_recall FROM macro""")
_register("class_report", lambda s, sf: rounded(
    E.class_report(_aligned(s, sf)), "precision", "recall", "f1"), """
SELECT problem, author, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM report""")
_register("accuracy", lambda s, sf: rounded(E.accuracy(_aligned(s, sf)), "accuracy"), """
SELECT problem, round(avg(CASE WHEN gold = silver THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM aligned GROUP BY problem""")


def evaluate_all(spark, sf):
    per_problem, overall = E.evaluate_all(_aligned(spark, sf))
    return per_problem.select("problem", *MACRO_COLUMNS).unionByName(
        overall.select(F.lit("overall").alias("problem"), F.col("overall_score").alias("macro_f1")),
        allowMissingColumns=True)


_register("evaluate_all", evaluate_all, """
SELECT problem, round(macro_f1, 3) AS macro_f1, round(macro_precision, 3) AS macro_precision,
       round(macro_recall, 3) AS macro_recall FROM macro
UNION ALL SELECT 'overall', round(avg(round(macro_f1, 3)), 3), NULL, NULL FROM macro""")


def language_mean(spark, sf):
    problems = C.docs(spark, sf).select("problem", "language").distinct()
    per_problem, _ = E.evaluate_all(_aligned(spark, sf))
    return rounded(E.language_mean(per_problem, problems), "mean_f1")


_register("language_mean", language_mean, """
SELECT problem AS language, round(avg(round(macro_f1, 3)), 6) AS mean_f1, count(*) AS n_problems
FROM macro GROUP BY problem""")


def unattributed_count(spark, sf):
    _, answers, gold = _case(spark, sf)
    expected = gold.groupBy("problem").agg(F.count_if(F.col("true_author") == "<UNK>").alias("expected"))
    return D.unattributed_count(answers, expected)


_register("unattributed_count", unattributed_count, """
SELECT problem, unattributed, n_answers, expected
FROM (SELECT problem, count(*) FILTER (predicted_author = '<UNK>') AS unattributed, count(*) AS n_answers
      FROM answers GROUP BY problem)
JOIN (SELECT problem, count(*) FILTER (true_author = '<UNK>') AS expected FROM truth GROUP BY problem)
USING (problem)""")


def snk_answers(spark, sf):
    scores, answers, _ = _case(spark, sf)
    return R.answer_stats(answers, scores.select("problem", "doc_name", "author", "p")).select(
        "problem", "doc_name", "predicted_author", F.array_join(
            F.transform("proba", lambda p: F.format_string("%.6f", p)), " ").alias("proba"))


_register("snk_answers", snk_answers, """
SELECT problem, doc_name, predicted_author, string_agg(printf('%.6f', p), ' ' ORDER BY author) AS proba
FROM answers JOIN scores USING (problem, doc_name) GROUP BY problem, doc_name, predicted_author""")


def snk_eval(spark, sf):
    return R.prototext(E.evaluate_all(_aligned(spark, sf))[1])


_register("snk_eval", snk_eval, r"""
SELECT 'measure {' || chr(10) || ' key: "mean macro-f1"' || chr(10) || ' value: "' ||
       CAST(round(avg(round(macro_f1, 3)), 3) AS VARCHAR) || '"' || chr(10) || '}' || chr(10) AS value
FROM macro""")


def pr_curve(spark, sf):
    scores, _, gold = _case(spark, sf)
    return rounded(E.pr_curve(scores, gold), "precision", "recall")


CURVE_SQL = """curve AS (
  SELECT problem, threshold, sum(hits) OVER down / sum(n) OVER down AS precision,
         sum(hits) OVER down / sum(hits) OVER (PARTITION BY problem) AS recall
  FROM (SELECT problem, p AS threshold, count(*) FILTER (author = true_author)::DOUBLE AS hits,
               count(*)::DOUBLE AS n
        FROM scores JOIN truth USING (problem, doc_name) GROUP BY ALL)
  WINDOW down AS (PARTITION BY problem ORDER BY threshold DESC))"""
QUERIES["pr_curve"] = pr_curve
ORACLES["pr_curve"] = C.sql(*ALIGNED_SQL, CURVE_SQL, """
SELECT problem, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve""")


def avg_precision(spark, sf):
    scores, _, gold = _case(spark, sf)
    return rounded(E.avg_precision(E.pr_curve(scores, gold)), "avg_precision")


QUERIES["avg_precision"] = avg_precision
ORACLES["avg_precision"] = C.sql(*ALIGNED_SQL, CURVE_SQL, """
SELECT problem, round(sum(step * precision), 6) AS avg_precision
FROM (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY problem ORDER BY threshold DESC), 0) AS step
      FROM curve) GROUP BY problem""")


def unknown_stats(spark, sf):
    scores, answers, gold = _case(spark, sf)
    stats = E.unknown_stats(scores, answers, gold)
    return rounded(stats, "max", "std", "min", "mean").withColumn("var", F.round("var", 9))


_register("unknown_stats", unknown_stats, """
SELECT problem, "case", round(max(top), 6) AS max, round(var_pop(top), 9) AS var,
       round(stddev_pop(top), 6) AS std, round(min(top), 6) AS min, round(avg(top), 6) AS mean, count(*) AS n
FROM (SELECT problem, p1 AS top,
             CASE WHEN true_author = '<UNK>' AND a.predicted_author <> '<UNK>' THEN 'false_known'
                  WHEN true_author <> '<UNK>' AND a.predicted_author = '<UNK>' THEN 'false_unknown'
                  WHEN true_author = '<UNK>' AND a.predicted_author = '<UNK>' THEN 'true_unknown' END AS "case"
      FROM top JOIN answers a USING (problem, doc_name) JOIN truth USING (problem, doc_name))
WHERE "case" IS NOT NULL GROUP BY ALL""")

GAPS = ("half_first_gap", "p2", "first_gap", "mean_gap", "late_gap")


def error_table(spark, sf):
    table = E.error_table(*_case(spark, sf))
    high = F.array_join(F.transform("high", lambda p: F.format_string("%.6f", p)), " ")
    return rounded(table.withColumn("high", high), *GAPS, digits=7)


_register("error_table", error_table, """
SELECT problem, doc_name, true_author, a.predicted_author, round((p1 - p2) / 2, 7) AS half_first_gap,
       round(p2, 7) AS p2, round(p1 - p2, 7) AS first_gap, round(((p1 - p2) + (p2 - p3)) / 2, 7) AS mean_gap,
       round((p2 - p4) / 2, 7) AS late_gap, t.predicted_author AS first,
       t.predicted_author = true_author AS first_right, second, second = true_author AS second_right,
       coalesce(h.high, '') AS high
FROM top t JOIN answers a USING (problem, doc_name) JOIN truth USING (problem, doc_name)
LEFT JOIN (SELECT problem, doc_name, string_agg(printf('%.6f', p), ' ' ORDER BY p DESC) AS high
           FROM scores WHERE p > 0.1 GROUP BY ALL) h USING (problem, doc_name)
WHERE (true_author = '<UNK>') <> (a.predicted_author = '<UNK>')""")


def oof_table(spark, sf):
    scores, _, gold = _case(spark, sf)
    proba = F.array_join(F.transform("proba", lambda p: F.format_string("%.6f", p)), " ")
    return E.oof_table(scores, gold).withColumn("proba", proba)


_register("oof_table", oof_table, f"""
SELECT problem, doc_name, CAST(ceil(i / 9.0) AS BIGINT) AS "group", predicted_author AS best,
       predicted_author = true_author AS hit, proba
FROM (SELECT problem, doc_name, predicted_author, true_author,
             row_number() OVER (PARTITION BY problem ORDER BY {ORDINAL_SQL}) AS i
      FROM top JOIN truth USING (problem, doc_name))
JOIN (SELECT problem, doc_name, string_agg(printf('%.6f', p), ' ' ORDER BY author) AS proba
      FROM scores GROUP BY ALL) USING (problem, doc_name)""")


# -- the whole method ---------------------------------------------------------------------------


def flagship(spark, sf):
    d = C.docs(spark, sf)
    answers = materialize(attribute_by_profile(C.known(d), C.unknown(d), pt=PT))
    gold = C.unknown(d).select("problem", "doc_name", "true_author")
    expected = gold.groupBy("problem").agg(F.count_if(F.col("true_author") == "<UNK>").alias("expected"))
    scores = rounded(E.macro_prf(E.align(gold, answers)), *MACRO_COLUMNS)
    return scores.join(D.unattributed_count(answers, expected), "problem")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = C.sql(
    *PROFILE3_SQL,
    """scores AS (
  SELECT problem, doc_name, author,
         round(CASE WHEN sum(cosine) OVER doc > 0 THEN cosine / sum(cosine) OVER doc ELSE 0 END, 6) AS p
  FROM cosines SEMI JOIN unknown USING (problem, doc_name)
  WINDOW doc AS (PARTITION BY problem, doc_name))""",
    "truth AS (SELECT problem, doc_name, true_author FROM unknown)",
    TOP_SQL,
    f"""answers AS (SELECT problem, doc_name, CASE WHEN p1 - p2 < {PT} AND (p1 - p3) / 2 < 0.07
  THEN '<UNK>' ELSE predicted_author END AS predicted_author FROM top)""",
    *ALIGNED_SQL[-3:], """
SELECT problem, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision,
       round(macro_recall, 6) AS macro_recall, unattributed, n_answers, expected
FROM macro
JOIN (SELECT problem, count(*) FILTER (predicted_author = '<UNK>') AS unattributed, count(*) AS n_answers
      FROM answers GROUP BY problem) USING (problem)
JOIN (SELECT problem, count(*) FILTER (true_author = '<UNK>') AS expected FROM truth GROUP BY problem) USING (problem)""")
