"""Every registered query with its oracle SQL."""

from __future__ import annotations

from palisade.operators import dataflow, endpoints, machines, project, relational, reports, runtime, state, symbols, text

QUERIES = text.R.queries | relational.R.queries | endpoints.R.queries | state.R.queries | reports.R.queries | dataflow.R.queries | project.R.queries | symbols.R.queries | machines.R.queries | runtime.R.queries
ORACLES = text.R.oracles | relational.R.oracles | endpoints.R.oracles | state.R.oracles | reports.R.oracles | dataflow.R.oracles | project.R.oracles | symbols.R.oracles | machines.R.oracles | runtime.R.oracles
