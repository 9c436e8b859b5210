"""Record operators on streams of files: the same transformations, one micro-batch at a time."""
