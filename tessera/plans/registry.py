"""Named queries over the panels and their SQL twins."""

from __future__ import annotations

from . import fits, models, portfolios, scale, series, tables

QUERIES: dict = {**series.Q, **portfolios.Q, **models.Q, **tables.Q, **scale.Q, **fits.Q}
ORACLE_SQL: dict = {**series.S, **portfolios.S, **models.S, **tables.S, **scale.S, **fits.S}
hl_series = portfolios.hl_series
