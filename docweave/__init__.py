"""Spark-first analytics for collections of versioned, semi-structured documents."""
