"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import datasets_q, eval_q, grid_q, io_q, model_q, profile_q, zones_q  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
