"""DuckDB SQL for every query, written apart from the Spark code."""

from oracle.queries import ORACLES

__all__ = ["ORACLES"]
