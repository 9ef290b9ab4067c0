"""All registered queries of the scene, fusion and tracking operators, with their SQL."""

from __future__ import annotations

from . import scene, tracking

FLAGSHIP = "scene_pipeline"
_MODULES = [scene, tracking]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
