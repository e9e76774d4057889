"""The query catalogue: name -> callable(spark, sf_dir), and name -> the same query in DuckDB's SQL."""

from __future__ import annotations

from tideline.plans import frames, labels, moments, pairing, relational, signals, time, vocabulary  # noqa: F401
from tideline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
