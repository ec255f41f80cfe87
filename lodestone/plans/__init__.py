"""Named queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

MODULES = ("delivery", "evidence", "series", "comparison", "intake", "streams", "pools", "spine", "rescan", "cards", "wedges")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return out


#: Counts and ranks that come out as 64-bit numbers, as they do in SQL.
WIDE = {
    "exemplars_top3": ["rank"], "top_comments": ["rank"], "title_slugs": ["words"], "matrix_problems": ["n"], "slope_shape_canonical": ["n"], "supply_shape": ["n"],
    "centroid": ["pos"], "nearest_neighbours": ["rank"], "contract_sort": ["rank"], "analysis_cap": ["rank"], "page_status": ["longest"], "window_plan": ["age"],
    "comparison_groups": ["grp"], "cells_recaptured": ["missing", "before"],
}


def _widened(query, columns: list[str]):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("bigint") for c in columns})

    run.__doc__ = query.__doc__
    return run


def queries() -> dict:
    return {name: _widened(q, WIDE[name]) if name in WIDE else q for name, q in _merged("QUERIES").items()}


def oracle_sql() -> dict:
    return _merged("ORACLES")
