"""folioweave: a Spark-native document-graph and corpus-preparation engine."""
