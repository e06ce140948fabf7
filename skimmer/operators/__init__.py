"""Sketches and their exact counterparts; a sketch is a small relation, its merge an aggregate."""
