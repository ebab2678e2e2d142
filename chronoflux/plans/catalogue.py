"""All registered queries; importing a plans module fills the registry."""

from chronoflux.plans import q_scalars, q_grid, q_joins, q_labels, q_rolling, q_events, q_skill, q_sources, q_audit, q_serve, q_models, q_periodic  # noqa: F401, I001
from chronoflux.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
