"""All queries of the engine: importing the modules registers them."""

from docloom.plans import answers, business, history, ingest, structure, texts  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES, Tables, runnable

__all__ = ["ORACLES", "QUERIES", "Tables", "runnable"]
