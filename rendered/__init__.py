"""Java trees rendered from the given tables: what the registered queries analyse.  Not part of the library."""
