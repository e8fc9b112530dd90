"""Part of tuffstone; see README.md."""
