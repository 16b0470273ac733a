"""Spark-native preparation, chunking, versioning and retrieval of document corpora."""
