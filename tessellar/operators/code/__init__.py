"""Code files into symbols, imports and identifier uses, and these into references."""
