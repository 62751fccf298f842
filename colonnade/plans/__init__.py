"""The textual plan language, its compiler, the query templates and the batch runner."""
