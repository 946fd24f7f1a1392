"""Which columns of a table play which role."""

from __future__ import annotations

from dataclasses import dataclass

#: Horizons of forward returns, in an entity's own sessions (fixed values).
HORIZONS = (5, 20, 60, 65, 180, 250, 260)
#: Rebalancing periods per year by horizon (fixed values).
PERIODS_PER_YEAR = {5: 52, 20: 12, 60: 4}
#: Names of the horizons with a calendar name (fixed values).
ALIASES = {"week": 5, "month": 20, "quarter": 60, "year": 250}
SCHEMES = ("equal", "float", "total")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a signal panel. ``float_cap`` and ``total_cap`` may be the same column."""

    entity: str = "entity"
    date: str = "date"
    ret: str = "ret"
    signal: str = "signal"
    float_cap: str = "cap"
    total_cap: str = "cap"
    periods_per_year: int = 52

    def require(self, columns: list[str]) -> None:
        missing = [c for c in (self.entity, self.date, self.ret, self.signal) if c not in columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
