"""Plans of docloom."""
