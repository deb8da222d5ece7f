"""quillrank: a Spark-native engine for top-N recommendation, ranking evaluation and corpus work."""
