"""Rule and knowledge tables (fixed values) read by the operators."""
