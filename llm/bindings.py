"""Imports every module that registers queries."""

from . import (  # noqa: F401
    bindings_bpe, bindings_divergence, bindings_iblt, bindings_langid, bindings_licences, bindings_linededup, bindings_mixing, bindings_neardup,
    bindings_periodic, bindings_tokenstore, bindings_topk, bindings_toxicity, bindings_warc,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
