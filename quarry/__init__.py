"""quarry: Spark-native preparation and auditing of agent-trajectory datasets."""
