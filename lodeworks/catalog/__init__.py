"""The queries of the library, one module per family."""
