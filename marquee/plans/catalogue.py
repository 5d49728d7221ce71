"""All registered queries; importing this module registers them."""
from . import grids, loading, pages, resolve, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
