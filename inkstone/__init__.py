"""inkstone: a Spark-native engine for curating and analysing text corpora."""
