"""Column functions: file names, sources, text, images and addresses."""
