"""Session settings and physical-plan helpers (sizing, materialisation)."""
