"""Query operators over quads: each takes and returns DataFrames."""
