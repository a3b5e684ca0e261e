"""Two-sample tests on samples of graphs, as Spark plans."""
