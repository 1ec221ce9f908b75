"""Queries of the library and their SQL, by name."""

from __future__ import annotations

from pacegrid.plans import loop_queries, network_queries, path_queries, route_queries, start_queries, street_queries, tile_queries

FLAGSHIP = street_queries.rank_candidates


def queries() -> dict:
    return street_queries.QUERIES | route_queries.QUERIES | start_queries.QUERIES | network_queries.QUERIES | path_queries.QUERIES | loop_queries.QUERIES | tile_queries.QUERIES


def oracle_sql() -> dict:
    return street_queries.SQL | route_queries.SQL | start_queries.SQL | network_queries.SQL | path_queries.SQL | loop_queries.SQL | tile_queries.SQL
