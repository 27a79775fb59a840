"""inkwell: a Spark-native engine for document analytics and hybrid retrieval."""
