"""The identification language: parser, compiler, and its plans."""
