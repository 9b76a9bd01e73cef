"""All queries of the library's own operators with their DuckDB counterparts."""

from __future__ import annotations

from barwright.plans import indicators, scores, streams, talk, trading, universe, upkeep

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (indicators, scores, trading, upkeep, universe, talk, streams):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
