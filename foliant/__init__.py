"""foliant: Spark jobs over large collections of documents."""
