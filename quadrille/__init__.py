"""Quadrille: schedule analytics and document processing as Spark jobs."""
