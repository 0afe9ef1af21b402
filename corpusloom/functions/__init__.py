"""functions of corpusloom."""
