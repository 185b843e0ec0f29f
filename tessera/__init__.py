"""tessera: Spark-native review analytics over corpora of files, and training-data operators."""
