"""Operators: the tables of a note, per-page summaries, SVG and PNG."""
