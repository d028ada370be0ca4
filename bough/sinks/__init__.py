"""Text outputs. Every sink sorts across the cluster and writes part files; read in name order
they are the exact file."""
