"""Registered queries: importing the modules below fills the registry."""

from __future__ import annotations

from importlib import import_module

MODULES = ("neighbour_queries", "link_queries", "sequence_queries", "select_queries", "graph_queries", "route_queries", "feature_queries", "report_queries", "job_queries", "disc_queries", "chain_queries")


def all_queries():
    for m in MODULES:
        import_module(f"roadpoints.plans.{m}")
    from roadpoints.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
