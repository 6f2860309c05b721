"""The pipeline language: strict objects, parsing, canonical form and JSON Schema."""
