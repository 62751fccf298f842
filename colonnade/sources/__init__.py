"""Tables: the catalog, text column files, row text files, and generated data."""
