"""Sources: files of notes, tables, and blobs."""
