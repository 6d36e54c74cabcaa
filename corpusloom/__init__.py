"""corpusloom: a Spark-native engine for building language-model training corpora."""
