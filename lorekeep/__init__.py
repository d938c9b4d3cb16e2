"""Search and analytics over archives of notes and conversation logs, as Spark jobs."""
