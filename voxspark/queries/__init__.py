"""Queries over the given tables, by the area they come from."""

from . import beads, crossval, fourier, images, ingest, planning, reports  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
