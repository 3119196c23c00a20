"""Pattern search and text processing over document collections as Spark plans."""
