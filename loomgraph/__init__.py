"""loomgraph: a Spark-native knowledge-graph analytics engine."""
