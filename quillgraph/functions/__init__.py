"""Part of quillgraph; see the README for the map of modules."""
