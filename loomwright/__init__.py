"""Query operators on documents, sections, runs and workflow graphs, as Spark plans."""
