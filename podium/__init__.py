"""podium: rank entities inside periods on Spark.

Feature preparation over (entity, period) rows, eligibility rules, strict
time splits, leakage guards, Spark ML scoring and winner-rank evaluation,
as DataFrame operators with column names as parameters.
"""

__version__ = "0.1.0"
