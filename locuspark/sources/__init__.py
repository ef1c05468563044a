"""Reading FASTQ and user tables, writing text formats."""
