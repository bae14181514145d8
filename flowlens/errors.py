"""Errors a caller is expected to act on."""

from __future__ import annotations


class FlowLensError(RuntimeError):
    """A wrong input, a missing table or an unusable parameter."""
