"""quillstone: a Spark-native engine of small, bounded, deterministic specialists."""
