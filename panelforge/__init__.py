"""panelforge: hierarchical time-series analytics as declarative Spark plans."""
