"""Plans composed of operators: hybrid retrieval, sample sizes."""
