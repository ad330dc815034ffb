"""The main method: feature families per language, calibrated SVMs, soft vote, reject rule."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators import decide as D
from inkprint.operators import models as M
from inkprint.operators import vectorize as V
from inkprint.operators.texts import stem_tokens, tag_strings
from inkprint.session import materialize, side_by_side

# Languages with extra families and the n-gram ranges of masked texts.
WORD_PAIR_LANGUAGES = ("english", "italian")
TAG_LANGUAGES = ("english", "spanish")
MASKED_RANGE = {"english": (2, 6)}
MASKED_DEFAULT = (1, 8)


def _fitted(docs: DataFrame, analyzer: V.Analyzer, min_df: float) -> DataFrame:
    return V.fit_tfidf(docs.where("split = 'known'"), analyzer, min_df).transform(docs)


def _named(features: DataFrame, family: str) -> DataFrame:
    return features.withColumn("family", F.lit(family))


def feature_recipe(docs: DataFrame, stems: DataFrame | None = None,
                   tags: DataFrame | None = None) -> DataFrame:
    """(family, problem, doc_name, term, value) of all families a language asks for.

    ``docs`` is (problem, language, doc_name, author, split, text) with full language names;
    authors are those of the known documents. All problems share one plan per family.
    """
    known = docs.where("split = 'known'")
    stemmed = docs if stems is None else materialize(stem_tokens(docs, stems))
    made: list[Callable[[], DataFrame]] = [
        lambda: _named(_fitted(docs, V.chars(3, 5), 0.12), "char"),
        lambda: _named(_fitted(stemmed, V.words(1, 3, T.default_tokens), 0.03), "word"),
    ]
    masked_sizes = F.col("language").isin(list(MASKED_RANGE))
    for rows, (low, high) in (
        *[(F.col("language") == name, sizes) for name, sizes in MASKED_RANGE.items()],
        (~masked_sizes, MASKED_DEFAULT),
    ):
        made.append(lambda rows=rows, low=low, high=high: _named(
            _fitted(docs.where(rows), V.chars(low, high, T.distort), 0.12), "masked"))

    def stacked(family: str, **parts: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: _named(V.hstack({name: part() for name, part in parts.items()}), family)

    made.append(stacked(
        "profile", c=lambda: V.fit_profile_chars(known).transform(docs),
        w=lambda: V.fit_profile_words(known).transform(stemmed)))
    paired = stemmed.where(F.col("language").isin(list(WORD_PAIR_LANGUAGES)))
    made.append(stacked(
        "word_pair", w1=lambda: _fitted(paired, V.words(1, 1, T.default_tokens), 0.03),
        w2=lambda: _fitted(paired, V.words(2, 2, T.default_tokens), 0.03)))
    if tags is not None:
        wanted = docs.where(F.col("language").isin(list(TAG_LANGUAGES))).drop("text")
        made.append(lambda: _named(
            _fitted(materialize(wanted.join(tag_strings(tags), V.DOC)), V.chars(4, 5), 0.12), "tag"))

    # Fitting a family runs jobs of its own that don't wait for the others'.
    return reduce(DataFrame.unionByName, side_by_side(made))


def scaled(features: DataFrame, known: DataFrame) -> DataFrame:
    """Each feature divided by its largest absolute value among the known documents."""
    trained = features.join(known.select(*V.DOC), V.DOC, "left_semi")
    return V.max_abs_scale(features, trained, ("family", "problem"))


def attribute(docs: DataFrame, stems: DataFrame | None = None, tags: DataFrame | None = None,
              weights: Mapping[str, float] | None = None, pt: float = 0.1, half: float = 0.07,
              c: float = 1.0, max_iter: int = M.SVM_ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(answers, scores) of the whole ensemble for the unknown documents."""
    known, unknown = docs.where("split = 'known'"), docs.where("split = 'unknown'")
    features = materialize(feature_recipe(docs, stems, tags))
    features = materialize(scaled(features, known))
    scores = M.multi_fit_predict(features, known, unknown, c=c, max_iter=max_iter)
    voted = materialize(D.soft_vote(scores, weights))
    return D.answers_for(unknown, D.reject_gap3(voted, pt, half)), voted


def attribute_by_counts(known: DataFrame, unknown: DataFrame, n: int = 3, ft: int = 5,
                        pt: float = 0.1, c: float = 1.0, gamma: float | None = None) -> DataFrame:
    """Baseline: relative n-gram counts, scaled, calibrated SVM with radial kernel, simple reject rule."""
    vocab = V.vocab_min_count(known, n, ft)
    docs = known.unionByName(unknown)
    counts = _named(V.count_by_length(docs, vocab, [n]), "counts")
    features = materialize(scaled(counts, known))
    scores = M.kernel_fit_predict(features, known, unknown, c=c, gamma=gamma)
    return D.answers_for(unknown, D.reject_gap(scores.drop("model"), pt))
