"""Functions of the engine, as DataFrame transforms."""
