"""All registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from . import aggregates, graphs, ledgers, markets, records, relational, series, states, wallets  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
