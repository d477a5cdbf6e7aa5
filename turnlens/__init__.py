"""A Spark-native analytics engine for multi-turn question-answering logs."""
