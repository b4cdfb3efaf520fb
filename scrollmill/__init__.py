"""PySpark-native compaction of agent transcripts held as DataFrames."""
