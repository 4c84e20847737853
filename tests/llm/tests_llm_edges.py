"""Edge rows shared by the tests of this folder."""
from test_contracts import EDGES, edge_docs  # noqa: F401
