"""cuework: Spark jobs for timed text and media catalogues."""
