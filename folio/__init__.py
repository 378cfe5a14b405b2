"""folio: a Spark-native engine for paged documents and text corpora."""
