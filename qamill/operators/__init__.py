"""DataFrame operators: chunking, papers, questions, gold, metrics, bias."""
