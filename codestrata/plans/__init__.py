"""End-to-end jobs composed from the operators; every value is a lazy DataFrame."""
