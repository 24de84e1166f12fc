"""Where quads come from and where they go."""
