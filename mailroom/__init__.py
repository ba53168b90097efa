"""Message-triage analytics as Spark jobs."""
