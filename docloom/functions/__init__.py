"""Functions of docloom."""
