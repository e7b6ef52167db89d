"""Part of vexel."""
