"""Sources and sinks: fixed literal relations and file formats (JSONL, binaryFile)."""
