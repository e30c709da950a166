"""weftgraph: a PySpark-native code-graph and document-processing engine."""
