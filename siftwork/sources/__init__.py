"""Reading datasets in, writing exports, builds and reports out."""
