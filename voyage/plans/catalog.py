"""The registered queries over the driver's tables."""

from __future__ import annotations

from voyage.plans import checks, evaluations, imports, journeys, models, tables, texts

QUERIES = journeys.QUERIES | evaluations.QUERIES | texts.QUERIES | models.QUERIES | imports.QUERIES | tables.QUERIES | checks.QUERIES
ORACLE = journeys.ORACLE | evaluations.ORACLE | texts.ORACLE | models.ORACLE | imports.ORACLE | tables.ORACLE | checks.ORACLE
FLAGSHIP = journeys.d12_forecast_targets
