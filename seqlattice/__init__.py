"""Row-pattern queries over event tables on Spark.

    from seqlattice import parse_sql, answer
    q = parse_sql(text)          # or load(path), a JSON specification or dependency graph
    answer(events, q).show()     # events: a DataFrame
"""

from .operators.compose import direct as answer
from .operators.compose import from_cover, view
from .pattern.frontend import load, parse_sql
from .pattern.graph import Graph
from .pattern.model import PatternQuery, QueryError
from .streaming.engine import Incremental
from .streaming.schedule import Firing

__all__ = ["Firing", "Graph", "Incremental", "PatternQuery", "QueryError", "answer", "from_cover", "load", "parse_sql", "view"]
