"""Sources and sinks: BAM, SAM, FASTA, name lists, tables of evidence, and guarded output files."""
