"""Column-to-column functions; all stay inside Catalyst."""
