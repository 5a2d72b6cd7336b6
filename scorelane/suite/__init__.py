"""Every operator as a query over the test tables, with the SQL that checks it."""

from scorelane.suite import arrays, joins, jobs, quality, reading, texts  # noqa: F401
from scorelane.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
