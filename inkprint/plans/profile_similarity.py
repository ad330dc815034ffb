"""Attribution by similarity with the author profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators import decide as D
from inkprint.operators import similarity as S
from inkprint.operators import vectorize as V


def attribute_by_profile(known: DataFrame, unknown: DataFrame, n: int = 3, min_df: float = 0.12,
                         pt: float = 0.002, half: float = 0.07) -> DataFrame:
    """(problem, doc_name, predicted_author, p1, p2, p3) for every unknown document.

    Character n-gram TF-IDF fitted on the profiles, cosine with each profile, shares per
    document, rejection of close calls. ``pt`` is small because shares lie close together.
    """
    fitted = V.fit_profile_chars(known, n, n, min_df)
    cosines = S.cosine_matrix(fitted.transform(unknown), fitted.profiles())
    candidates = known.select("problem", "author").distinct()
    full = S.complete_scores(unknown, candidates, cosines, "cosine")
    shares = S.share_per_document(full, "cosine").withColumn("p", F.round("p", 6))
    return D.answers_for(unknown, D.reject_gap3(shares, pt, half))
