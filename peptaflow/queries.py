"""Registry of the engine's own queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from .plans import models, relational, sequences, windows  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLES, QUERIES  # noqa: F401
