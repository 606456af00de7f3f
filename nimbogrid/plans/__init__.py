"""Named queries over the provided tables; importing this package fills QUERIES and ORACLES."""

from . import q_derived, q_ensemble, q_forward, q_grid, q_joins, q_more, q_obs, q_reduce, q_regrid, q_scalar, q_sets, q_stats, q_stream, q_time  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
