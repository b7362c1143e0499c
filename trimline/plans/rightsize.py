"""From samples and pod specs to patterns and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trimline.operators.features import annotate, classify, features, series_steps, usage_profile
from trimline.operators.recommend import recommendations
from trimline.params import Sizing, Tiering


def profile(samples: DataFrame, specs: DataFrame, t: Tiering, s: Sizing) -> DataFrame:
    return annotate(usage_profile(series_steps(samples, t, s), specs, s), s)


def patterns(samples: DataFrame, specs: DataFrame, t: Tiering, s: Sizing) -> DataFrame:
    return classify(features(profile(samples, specs, t, s)), s)


def recommend(samples: DataFrame, specs: DataFrame, t: Tiering, s: Sizing) -> DataFrame:
    return recommendations(patterns(samples, specs, t, s), s)
