"""The document pipeline as DataFrame transforms: classify, gate, refine, merge, map, write."""
