"""Package of the engine; see the README."""
