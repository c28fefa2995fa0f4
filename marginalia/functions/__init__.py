"""Part of marginalia; see the README for the map of modules."""
