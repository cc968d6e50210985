"""weftgraph: a property-graph analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
