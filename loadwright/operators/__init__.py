"""DataFrame -> DataFrame operators, catalog side and data side."""
