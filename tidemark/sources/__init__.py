"""Sources: folders of files, inline rows, JSONL cases, transcripts and ignore files."""
