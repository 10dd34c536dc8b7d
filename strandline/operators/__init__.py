"""Relational operators: joins, fusion, grids, ordered scans, state and identity."""
