"""gleaner: a Spark-native engine for captured web artifacts and text corpora."""
