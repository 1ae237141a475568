"""vellum: handwriting-note containers and training corpora as Spark tables."""
