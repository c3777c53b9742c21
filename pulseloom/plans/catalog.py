"""All queries and their SQL."""

from pulseloom.plans import groups, hrv, inference, models

QUERIES: dict = {}
ORACLES: dict = {}
for part in (hrv, groups, models, inference):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
