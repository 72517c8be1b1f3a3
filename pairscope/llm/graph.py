"""Connected components of a link table, as the rest of the library has them."""

from __future__ import annotations

from pairscope.operators.graph import components

__all__ = ["components"]
