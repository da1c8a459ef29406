"""Spark-native scaffolding analytics: alignments, hypergraphs, contact graphs, chains, scaffolds."""
