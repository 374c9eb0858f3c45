"""Every query of the library: importing the modules registers them."""

from __future__ import annotations

from memspark.plans import composed, filters, jobs, passages, retrieval, stores, summaries, timelines
from memspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "composed", "filters", "jobs", "passages", "retrieval", "stores", "summaries", "timelines"]
