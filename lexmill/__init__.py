"""lexmill: a Spark-first engine for searching and preparing collections of documents."""
