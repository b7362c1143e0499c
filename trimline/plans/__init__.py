"""Whole reports composed from operators; each function is one lazy DataFrame plan."""
