"""Content analytics on Spark: crawl snapshots, extraction, chunking, signals, similarity, ranking."""
