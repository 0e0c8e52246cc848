"""Queries: one for each operator and workload, with SQL that gives the same rows."""
