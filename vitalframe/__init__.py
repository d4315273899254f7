"""vitalframe: a PySpark-native pipeline for tabular cardiovascular-risk data.

Every stage is a ``DataFrame -> DataFrame`` function composed with
``df.transform``: profile and validate raw patient records, clean them with
rule filters and a first-failure rejection report, derive clinical features,
split and scale, fit and tune Spark ML classifiers, evaluate with exact
distributed metrics, and score populations (batch or streaming) with risk
levels, ranked contributors, recommendations and what-if scenarios.
"""

from vitalframe.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
