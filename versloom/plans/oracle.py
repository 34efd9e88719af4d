"""DuckDB SQL by query name."""

from versloom.plans import queries  # noqa: F401
from versloom.plans.registry import ORACLE_SQL  # noqa: F401
