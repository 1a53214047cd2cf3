"""diskloom: a Spark-native engine that builds, queries and cleans a catalogue of discs from many disagreeing sources."""
