"""Seeded generators with exact ground truth, table readers, and result documents."""
