"""Functions: byte-level decoders for Arrow stages, and Column builders for everything after."""
