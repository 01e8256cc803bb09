"""quaestor: a Spark-first engine for document question answering and its data pipelines."""
