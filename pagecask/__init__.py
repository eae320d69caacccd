"""pagecask: a PySpark engine for searching and maintaining an archive of pages."""
