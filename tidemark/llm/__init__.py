"""Training-data operators: thirteen operators over text, vectors and web pages."""
