"""All queries of the subpackage, and the SQL of those that SQL can express."""

from refmill.llm.oracles import ORACLES
from refmill.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
