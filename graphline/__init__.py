"""graphline: reachability analytics over directed property graphs, on Spark DataFrames."""

__version__ = "0.1.0"
