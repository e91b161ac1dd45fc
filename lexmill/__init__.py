"""lexmill: a Spark-native engine that prepares and measures language-model text corpora."""
