"""Where tensors come from: literals, tables, functions and files."""
