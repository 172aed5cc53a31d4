"""Typed hypergraphs, event logs and experiment tables as Spark jobs."""

from .operators import bootstrap as boot
from .operators import claims, effects, eventlog, trust
from .operators import pointprocess as pp
from .operators.graph import Attr, Catalog, EdgeType, Graph, Port, VertexType
from .operators.match import ANY, NAC, PAC, E, Pattern, V, Var, matches
from .operators.rewrite import NE, NV, Ex, Rule, apply_batch, occurrences
from .streaming import stateful as streams

__all__ = [
    "ANY", "Attr", "Catalog", "E", "EdgeType", "Ex", "Graph", "NAC", "NE", "NV", "PAC", "Pattern", "Port", "Rule", "V", "Var", "VertexType",
    "apply_batch", "boot", "claims", "effects", "eventlog", "matches", "occurrences", "pp", "streams", "trust",
]
