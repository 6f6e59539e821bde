"""graphloom: event-sourced property graphs and hybrid retrieval as Spark DataFrames."""

__version__ = "0.1.0"
