"""Readers and writers: FASTA, FASTQ, plain text, pattern batches, records, and the index tables."""
