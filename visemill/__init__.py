"""visemill: Spark jobs for audio-visual speech tables and for text corpora."""
